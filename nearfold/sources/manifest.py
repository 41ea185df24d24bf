"""Manifests of labelled pairs, and readers and writers of the store's tables."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import staged_path

PAIRS = "pairs array<struct<media_type: string, name: string, left: string, right: string, expected_match: boolean>>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``media_type, name, left, right, expected`` of a manifest; relative paths count from its folder."""
    base = posixpath.dirname(path)
    rows = spark.read.schema(PAIRS).option("multiLine", True).json(path).select(F.explode("pairs").alias("p"))
    full = lambda c: F.when(F.col(c).startswith("/"), F.col(c)).otherwise(F.concat(F.lit(f"{base}/"), F.col(c)))
    return rows.select("p.media_type", "p.name", full("p.left").alias("left"), full("p.right").alias("right"), F.col("p.expected_match").alias("expected"))


def read_store(spark: SparkSession, path: str) -> DataFrame | None:
    """A stored table, None where there is none yet."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
    return spark.read.parquet(path) if there else None


def replace_store(rows: DataFrame, path: str) -> None:
    """Write a table anew, also one that ``rows`` reads: the new files are complete before the old ones go."""
    spark = rows.sparkSession
    aside = staged_path(spark, "store")
    rows.write.parquet(aside)
    spark.read.parquet(aside).write.mode("overwrite").parquet(path)
