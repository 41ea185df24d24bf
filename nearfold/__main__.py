"""``python -m nearfold --folders A B``: scan folders, fingerprint what is new, compare, write reports; ``--inspect-cache`` shows the store."""

from __future__ import annotations

import argparse
import logging
import os
import sys
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Cancelled, Engine, html_report, json_report
from .functions.hashing import full_digest, partial_digest
from .operators.exact import collided
from .operators.store import cleared, counts_by, hydrated, statistics, upserted
from .options import Options, load
from .runtime import stage
from .sources.listing import scan
from .sources.manifest import read_store, replace_store
from .sources.media import FfmpegDecoder, fingerprints

LOG = logging.getLogger("nearfold")
PRINTS = ("duration", "fingerprint", "fingerprint_version", "image_fingerprint", "audio_fingerprint")


def parsed(arguments: list[str]) -> tuple[str | None, dict]:
    parser = argparse.ArgumentParser(prog="nearfold")
    parser.add_argument("--config")
    parser.add_argument("--folders", nargs="+")
    parser.add_argument("--extensions", nargs="+")
    for name in ("output", "json-output", "cache", "name-provider", "lmstudio-url", "lmstudio-model", "ffmpeg", "ffprobe", "log-level"):
        parser.add_argument(f"--{name}")
    for name in ("video", "image", "audio", "folder", "name"):
        parser.add_argument(f"--{name}-threshold", type=float)
    parser.add_argument("--workers", type=int)
    for name in ("skip-video", "skip-images", "skip-audio", "refresh-hashes", "refresh-video", "refresh-images", "refresh-audio", "refresh-names", "inspect-cache"):
        parser.add_argument(f"--{name}", action="store_true", default=None)
    given = vars(parser.parse_args(arguments))
    return given.pop("config"), given


def scanned(spark: SparkSession, options: Options) -> DataFrame:
    """The files of the folders with what the store knows of them; new media are decoded where ffmpeg is there."""
    files = scan(spark, options.folders, options.extensions)
    files = stage(files, "scanned")
    for row in files.where("error is not null").select("path", "root", "error").toLocalIterator():
        LOG.warning("%s: %s", row.path or row.root, row.error)
    files = files.where("error is null").drop("error")
    stored = read_store(spark, options.cache)
    if stored is not None:
        for kind in ("hashes", "video", "images", "audio"):
            stored = cleared(stored, files, kind) if getattr(options, f"refresh_{kind}") else stored
        files = hydrated(files, stored)
    else:
        empty = {"full_hash": "string", "duration": "double", "fingerprint": "array<long>", "fingerprint_version": "int", "image_fingerprint": "array<long>", "audio_fingerprint": "array<long>"}
        files = files.withColumns({**{c: F.lit(None).cast(t) for c, t in empty.items()}, "reused": F.lit(False)})
    files = stage(with_hashes(files), "hashed")
    decoder = FfmpegDecoder(options.ffmpeg, options.ffprobe)
    if decoder.available():
        skip = {k for k, off in (("video", options.skip_video), ("image", options.skip_images), ("audio", options.skip_audio)) if off}
        fresh = fingerprints(files.where("not reused"), decoder, skip, options.workers)
        files = files.join(fresh.toDF("path", *(f"new_{c}" for c in PRINTS), "error"), "path", "left")
        files = files.withColumns({c: F.coalesce(f"new_{c}", c) for c in PRINTS}).drop(*(f"new_{c}" for c in PRINTS), "error")
    else:
        LOG.warning("ffmpeg or ffprobe is missing: media that the store does not know are compared by content and name only")
    files = stage(files.drop("reused"), "fingerprinted")
    replace_store(files if stored is None else upserted(stored, files, "path"), options.cache)
    return files


def with_hashes(files: DataFrame) -> DataFrame:
    """Full hashes of files that share their size and then their partial hash; only those are read whole, in pieces."""
    sized = collided(files, "size").where("full_hash is null").select("path", "size")
    partial = stage(sized.mapInPandas(digested(partial_digest), "path string, size long, digest string"), "partial-hashes")
    # a file whose hash is stored may have the content of any other of its size
    known = files.where("full_hash is not null").select("size").distinct()
    asked = collided(partial, "size", "digest").select("path", "size").union(partial.join(known, "size", "left_semi").select("path", "size")).distinct()
    hashed = asked.mapInPandas(digested(full_digest), "path string, size long, digest string").select("path", F.col("digest").alias("computed"))
    return files.join(hashed, "path", "left").withColumn("full_hash", F.coalesce("full_hash", "computed")).drop("computed")


def digested(digest):
    """Batches of (path, size) to (path, size, digest), read in the task; files that cannot be read are left out."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, size in zip(batch["path"], batch["size"]):
                try:
                    rows.append((path, size, digest(path)))
                except OSError as error:
                    LOG.warning("%s: %s", path, error)
            yield pd.DataFrame(rows, columns=["path", "size", "digest"])

    return run


def main(arguments: list[str] | None = None) -> int:
    config, settings = parsed(sys.argv[1:] if arguments is None else arguments)
    try:
        options = load(config, os.environ, **settings)
    except (OSError, ValueError) as error:
        print(f"nearfold: {error}", file=sys.stderr)
        return 2
    logging.basicConfig(level=options.log_level)
    if not options.folders and not options.inspect_cache:
        print("nearfold: no folders given", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("nearfold").getOrCreate()
    if options.inspect_cache:
        stored = read_store(spark, options.cache)
        if stored is None:
            print("the store is empty")
        else:
            statistics(stored).show(truncate=False)
            counts_by(stored, "fingerprint_version").show(truncate=False)
        return 0
    try:
        decoder = FfmpegDecoder(options.ffmpeg, options.ffprobe)
        engine = Engine(
            spark, lambda event: LOG.log(logging.WARNING if event.kind == "warning" else logging.INFO, "%s %s %s", event.stage, event.kind, event.message),
            decoder=decoder if decoder.available() else None,
        )
        results = engine.run(scanned(spark, options), options)
    except (Cancelled, KeyboardInterrupt):
        return 130
    json_report(results).write.mode("overwrite").partitionBy("section").text(options.json_output)
    Path(options.output).write_text(html_report(results), encoding="utf-8")
    return 0


if __name__ == "__main__":
    sys.exit(main())
