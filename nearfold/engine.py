"""One run over a table of files: every stage a function of DataFrames, stages cut where their results are used again."""

from __future__ import annotations

import html
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import clusters, exact, matching, naming
from .options import Options
from .runtime import ship_package, stage
from .sources.media import Decoder, refingerprinter

STAGES = ("scanning", "exact", "video", "images", "audio", "names", "clustering")


class Cancelled(Exception):
    """The run was stopped between two stages."""


@dataclass
class Event:
    kind: str  # started, completed, skipped, warning, failed, cancelled
    stage: str
    message: str = ""


@dataclass
class Results:
    files: DataFrame
    exact: DataFrame
    video: DataFrame
    image: DataFrame
    audio: DataFrame
    names: DataFrame
    hints: DataFrame
    clusters: DataFrame
    folders: DataFrame

    def parts(self) -> dict[str, DataFrame]:
        return {k: getattr(self, k) for k in ("exact", "video", "image", "audio", "hints", "folders")}


class Engine:
    """``Engine(spark).run(files, options)``: exact groups, alike media, name hints, clusters and folder overlap.

    ``files`` has the columns of the files table. Fingerprints come with it, or from ``sources.media``.
    With a ``decoder`` video pairs just below the threshold get a second pass by realignment.
    """

    def __init__(
        self, spark: SparkSession, on_event: Callable[[Event], None] | None = None, cancelled: Callable[[], bool] | None = None, decoder: Decoder | None = None
    ):
        self.spark, self.on_event, self.cancelled, self.decoder = spark, on_event or (lambda event: None), cancelled or (lambda: False), decoder
        self.tag = f"nearfold-{uuid.uuid4().hex[:12]}"

    def _stage(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if self.cancelled():
            self.spark.sparkContext.cancelJobsWithTag(self.tag)  # of this run only
            self.on_event(Event("cancelled", name))
            raise Cancelled(name)
        self.on_event(Event("started", name))
        self.spark.sparkContext.setJobDescription(name)
        try:
            made = stage(build(), name)
        except Exception as error:
            self.on_event(Event("failed", name, str(error).split("\n")[0]))
            raise
        self.on_event(Event("completed", name))
        return made

    def _skipped(self, name: str, schema: str) -> DataFrame:
        self.on_event(Event("skipped", name))
        return self.spark.createDataFrame([], schema)

    def run(self, files: DataFrame, options: Options | None = None, stored_names: DataFrame | None = None) -> Results:
        """All stages over ``files``; matches, hints and folder pairs come in the order of a report."""
        self.spark.sparkContext.addJobTag(self.tag)
        try:
            return self._run(files, options, stored_names)
        finally:
            self.spark.sparkContext.removeJobTag(self.tag)

    def _run(self, files: DataFrame, options: Options | None, stored_names: DataFrame | None) -> Results:
        options = options or Options()
        ship_package(self.spark)
        files = self._stage("scanning", lambda: files)
        groups = self._stage("exact", lambda: exact.exact_groups(files))
        pair = "ord_a long, ord_b long, similarity double, delta double"
        paths = files.select("ord", "path")

        def named(pairs: DataFrame, level: str) -> DataFrame:
            a, b = paths.toDF("ord_a", "path_a"), paths.toDF("ord_b", "path_b")
            both = pairs.join(a, "ord_a").join(b, "ord_b")
            delta = F.round("delta", 3) if "delta" in pairs.columns else F.lit(None).cast("double")
            return both.select(
                F.least("path_a", "path_b").alias("left"), F.greatest("path_a", "path_b").alias("right"),
                F.round("similarity", 2).alias("similarity"), delta.alias("duration_delta"), F.lit(level).alias("level"),
            )

        def all_videos() -> DataFrame:
            rows = matching.videos(files)
            if self.decoder is None:
                self.on_event(Event("warning", "video", "no decoder: pairs below the threshold are not realigned"))
                return matching.video_matches(rows, rows, options.video_threshold, once=True)
            pairs = stage(matching.video_matches(rows, rows, options.video_threshold, recheck=True, once=True), "video-recheck")
            return matching.realigned(pairs, files, refingerprinter(self.decoder), options.video_threshold)

        video = self._stage("video", lambda: named(all_videos(), "video")) if not options.skip_video else named(self._skipped("video", pair), "video")
        image = self._stage("images", lambda: named(matching.image_matches(files, options.image_threshold), "image")) if not options.skip_images else named(self._skipped("images", pair), "image")
        audio = self._stage("audio", lambda: named(matching.audio_matches(files, options.audio_threshold), "audio")) if not options.skip_audio else named(self._skipped("audio", pair), "audio")
        matches = video.union(image).union(audio)
        members = groups.select("hash_value", F.explode("paths").alias("path"))

        def titled() -> DataFrame:
            contextual = naming.contextual_names(files)
            store = stored_names if stored_names is not None else self.spark.createDataFrame([], "raw_name string, core_title string, year int, episode int")
            found = naming.looked_up(contextual.select("name").distinct(), store)
            return contextual.join(found, "name").join(paths, "path")

        names = self._stage("names", titled)
        confirmed = members.select("path").union(matches.select("left")).union(matches.select("right")).distinct()
        hints = naming.all_hints(names, confirmed, options.name_threshold)
        found = self._stage("clustering", lambda: clusters.assignments(files, members, matches, names))
        folders = clusters.folders_in_order(clusters.folder_pairs(found, options.folder_threshold))
        video, image, audio = (matching.in_order(m) for m in (video, image, audio))
        return Results(files, groups, video, image, audio, names, naming.hints_in_order(hints), found, folders)


def json_report(results: Results) -> DataFrame:
    """One JSON text per result row: ``section, json``; a section's rows together are its part of the report."""
    parts = [df.select(F.lit(name).alias("section"), F.to_json(F.struct("*")).alias("json")) for name, df in results.parts().items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def nested_report(results: Results) -> DataFrame:
    """The whole report as one JSON object per section: ``section, json``, its rows an array in their order.

    A section is one value here, so this is for reports that fit into one; ``json_report`` has a row per result.
    """
    parts = [
        df.select(F.lit(name).alias("section"), F.monotonically_increasing_id().alias("nth"), F.to_json(F.struct("*")).alias("json"))
        for name, df in results.parts().items()
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.union(part)
    listed = rows.groupBy("section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "json"))), lambda r: r["json"]), ",").alias("rows"))
    every = rows.sparkSession.createDataFrame([(name,) for name in results.parts()], "section string")
    return every.join(listed, "section", "left").select("section", F.concat(F.lit("["), F.coalesce("rows", F.lit("")), F.lit("]")).alias("json"))


def html_report(results: Results, rows: int = 200) -> str:
    """A page with the first ``rows`` rows of each section, which says how many there are; what it shows is escaped."""
    page = ["<!doctype html><meta charset='utf-8'><title>Near-duplicates</title>"]
    for name, df in results.parts().items():
        page.append(f"<h2>{html.escape(name)}</h2><table><tr>{''.join(f'<th>{html.escape(c)}</th>' for c in df.columns)}</tr>")
        page += [f"<tr>{''.join(f'<td>{html.escape(str(v))}</td>' for v in r)}</tr>" for r in df.limit(rows).collect()]
        page.append("</table>")
        if (total := df.count()) > rows:
            page.append(f"<p>The first {rows} of {total}; the JSON report has them all.</p>")
    return "\n".join(page)
