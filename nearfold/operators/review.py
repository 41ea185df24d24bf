"""Results of all kinds as one list of review items, counts per kind, filters, and the nested report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.media import suffix

CATEGORIES = ("exact", "video", "image", "audio", "folder", "name")
MIB = 1024.0 * 1024.0


def item(category: str, rows: DataFrame, paths: Column, confidence: Column, evidence: Column, *order) -> DataFrame:
    """``category, paths, confidence, evidence`` and what orders the items of one category."""
    return rows.select(F.lit(category).alias("category"), paths.alias("paths"), confidence.cast("double").alias("confidence"), evidence.alias("evidence"), F.struct(*order).alias("order"))


def review_items(parts: list[DataFrame]) -> DataFrame:
    """All parts together; their ``order`` is dropped, items are found again by category and paths."""
    return reduce(DataFrame.unionByName, (p.drop("order") for p in parts))


def numbered(items: DataFrame, *order) -> DataFrame:
    """One category's items with a title that counts from 1."""
    nth = F.row_number().over(Window.partitionBy("category").orderBy(*order))
    return items.withColumn("title", F.concat(F.initcap("category"), F.lit(" "), nth.cast("string")))


def category_counts(items: DataFrame) -> DataFrame:
    """Items per category, those with none too, and all together."""
    counts = items.groupBy("category").agg(F.count("*").alias("n"))
    every = items.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "category string")
    filled = every.join(counts, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))
    return filled.union(items.agg(F.lit("all"), F.count("*")))


def filtered(items: DataFrame, category: str = "all") -> DataFrame:
    return items if category == "all" else items.where(F.col("category") == category)


def compression_filter(videos: DataFrame, extensions: set[str], min_mib: float = 0, max_mib: float = 0, min_minutes: float = 0, max_minutes: float = 0) -> DataFrame:
    """Videos (path, size, duration) of the given suffixes within size and length limits; a maximum of 0 is none."""
    size, minutes = F.col("size") / MIB, F.coalesce("duration", F.lit(0.0)) / 60.0
    kept = videos.where(suffix(F.col("path")).isin(*sorted(extensions)) & (size >= min_mib) & (minutes >= min_minutes))
    kept = kept.where(size <= max_mib) if max_mib > 0 else kept
    return kept.where(minutes <= max_minutes) if max_minutes > 0 else kept


def compression_summary(videos: DataFrame, checked: DataFrame) -> DataFrame:
    """``loaded, checked, bytes``: videos listed, videos ticked (path), and the bytes of these."""
    ticked = videos.join(checked.select("path").distinct().withColumn("ticked", F.lit(1)), "path", "left")
    return ticked.agg(F.count("*").alias("loaded"), F.count("ticked").alias("checked"), F.coalesce(F.sum(F.when(F.col("ticked") == 1, F.col("size"))), F.lit(0)).alias("bytes"))


def output_checks(outputs: DataFrame) -> DataFrame:
    """``outputs`` with ``problems`` and ``smaller``: what speaks against an encoded file.

    Reads source_*/output_* duration, size, chapters and counts of video, audio, subtitle streams, and ``decodes``.
    """
    allowed = F.greatest(F.lit(1.0), F.col("source_duration") * 0.005)
    problems = [
        F.when(F.abs(F.col("source_duration") - F.col("output_duration")) > allowed, F.lit("duration")),
        *(F.when(F.col(f"output_{k}") < F.col(f"source_{k}"), F.lit(k)) for k in ("video", "audio", "subtitle", "chapters")),
        F.when(~F.col("decodes"), F.lit("first frame")),
    ]
    return outputs.withColumns({"problems": F.array_compact(F.array(*problems)), "smaller": F.col("output_size") < F.col("source_size")})
