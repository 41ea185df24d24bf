"""Exact duplicates by stages: byte size, partial hash, full hash; contents are read only where the stage before collided."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import ALGORITHM, full_hash, partial_hash


def collided(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys occur more than once; rows with a null key do not."""
    known = rows.dropna(subset=list(keys))
    repeated = known.groupBy(*keys).count().where(F.col("count") > 1).select(*keys)
    return known.join(repeated, list(keys), "left_semi")


def hashed_contents(contents: DataFrame, content: str = "content", size: str = "size") -> DataFrame:
    """``contents`` with partial_hash for rows that share their size, and full_hash for those that also share that."""
    sized = collided(contents, size).withColumn("partial_hash", partial_hash(F.col(content)))
    both = collided(sized, size, "partial_hash")
    return both.withColumns({"full_hash": full_hash(F.col(content)), "full_hash_algo": F.lit(ALGORITHM)})


def exact_groups(files: DataFrame) -> DataFrame:
    """``hash_value, size, copies, paths, similarity``: groups of two or more files of one full hash.

    Where ``files`` names the algorithm (full_hash_algo) digests of different ones are not compared.
    ``size`` is that of the file first in ``ord``; ``paths`` are sorted. Files without a hash are in no
    group. A group's paths are one value; ``exact_members`` gives them a row each.
    """
    hashed = files.where("full_hash is not null")
    algorithm = ["full_hash_algo"] if "full_hash_algo" in files.columns else []
    return (
        hashed.groupBy(F.col("full_hash").alias("hash_value"), *algorithm)
        .agg(F.min_by("size", "ord").alias("size"), F.count("*").alias("copies"), F.array_sort(F.collect_list("path")).alias("paths"))
        .where("copies > 1").drop("full_hash_algo").withColumn("similarity", F.lit(100.0))
    )


def exact_members(files: DataFrame) -> DataFrame:
    """``hash_value, path, first_path, copies``: a row per file of a group, however many the group has."""
    algorithm = F.coalesce("full_hash_algo", F.lit("")) if "full_hash_algo" in files.columns else F.lit("")
    hashed = files.where("full_hash is not null").select(F.col("full_hash").alias("hash_value"), algorithm.alias("algorithm"), "path")
    keys = ["hash_value", "algorithm"]
    groups = hashed.groupBy(*keys).agg(F.min("path").alias("first_path"), F.count("*").alias("copies")).where("copies > 1")
    return hashed.join(groups, keys).select("hash_value", "path", "first_path", "copies")
