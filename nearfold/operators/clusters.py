"""Clusters of files over all evidence, and how far the folders they came from overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import title_key
from .components import components

MEDIA = ("video", "image", "audio")


def assignments(files: DataFrame, exact: DataFrame, matches: DataFrame, names: DataFrame) -> DataFrame:
    """``path, root, cluster_id, level, confidence`` for every file.

    ``exact`` has hash_value and path, one row per file of an exact group; ``matches`` left, right,
    similarity and level; ``names`` path, core_title, year, episode. Files linked by content share a
    cluster, named after its smallest path. Its level is the kind of match inside it, ``content`` for
    several kinds and ``exact`` for none; its confidence the smallest similarity of its matches. Other
    files are clustered by name, or stay alone.
    """
    paths = files.select("path")
    inside = matches.join(paths.withColumnRenamed("path", "left"), "left", "left_semi").join(paths.withColumnRenamed("path", "right"), "right", "left_semi")
    inside = inside.select("left", "right", "similarity", "level")
    first = exact.groupBy("hash_value").agg(F.min("path").alias("left"))
    chains = exact.join(first, "hash_value").select("left", F.col("path").alias("right"))
    parts = components(chains.union(inside.select("left", "right"))).withColumnRenamed("node", "path")
    evidence = inside.join(parts.withColumnRenamed("path", "left"), "left").groupBy("component").agg(
        F.count_distinct("level").alias("kinds"), F.min("level").alias("kind"), F.min("similarity").alias("least")
    )
    level = F.when(F.col("kinds").isNull(), "exact").when(F.col("kinds") > 1, "content").otherwise(F.col("kind"))
    linked = parts.join(evidence, "component", "left").select(
        "path", F.concat(level, F.lit(":"), "component").alias("content_id"), level.alias("content_level"), F.coalesce("least", F.lit(100.0)).alias("content_confidence")
    )
    title = title_key(F.col("core_title"))
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    named = F.when(title != "", F.concat(F.lit("name:"), F.concat_ws("|", title, number("year"), number("episode"))))
    return files.select("path", "root").join(linked, "path", "left").join(names.select("path", named.alias("name_id")), "path", "left").select(
        "path", "root", F.coalesce("content_id", "name_id", F.concat(F.lit("path:"), "path")).alias("cluster_id"),
        F.coalesce("content_level", F.when(F.col("name_id").isNotNull(), "name"), F.lit("path")).alias("level"),
        F.coalesce("content_confidence", F.when(F.col("name_id").isNotNull(), 70.0), F.lit(0.0)).alias("confidence"),
    )


def _overlap(sets: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Shared ids per pair of roots, and ids per root, of distinct (root, id) rows."""
    a, b = sets.toDF("left", "id"), sets.toDF("right", "id")
    shared = a.join(b, "id").where("left < right").groupBy("left", "right").agg(F.count("*").alias(f"{name}_shared"))
    return shared, sets.groupBy("root").agg(F.count("*").alias(name))


def folder_pairs(clusters: DataFrame, threshold: float = 50.0) -> DataFrame:
    """Pairs of roots with the shares of clusters they have in common, by content and with names.

    Files without content evidence count for the content score as clusters of their own, so they
    enlarge the union. A pair is kept if either score reaches the threshold. Pairs that share nothing
    score 0 and are built only for a threshold of 0, from the few distinct roots.
    """
    content = F.when(F.col("level").isin("name", "path"), F.concat(F.lit("unconfirmed:"), "path")).otherwise(F.col("cluster_id"))
    names, named = _overlap(clusters.select("root", F.col("cluster_id").alias("id")).distinct(), "name")
    contents, counted = _overlap(clusters.select("root", content.alias("id")).distinct(), "content")
    pairs = names.join(contents, ["left", "right"], "full_outer")
    if threshold <= 0:
        roots = clusters.select("root").distinct()
        every = roots.toDF("left").join(roots.toDF("right"), F.col("left") < F.col("right"))
        pairs = every.join(pairs, ["left", "right"], "left")
    for kind, sizes in (("name", named), ("content", counted)):
        pairs = pairs.join(sizes.toDF("left", f"{kind}_left"), "left").join(sizes.toDF("right", f"{kind}_right"), "right").fillna(0, [f"{kind}_shared"])
    share = lambda k: F.lit(100.0) * F.col(f"{k}_shared") / (F.col(f"{k}_left") + F.col(f"{k}_right") - F.col(f"{k}_shared"))
    scored = pairs.select("left", "right", *(f"{k}_{c}" for k in ("content", "name") for c in ("shared", "left", "right")), share("content").alias("content_similarity"), share("name").alias("name_similarity"))
    return scored.where((F.col("content_similarity") >= threshold) | (F.col("name_similarity") >= threshold))


def one_sided(clusters: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    """``left, right, path``: files of one side of folder pairs whose cluster the other side lacks."""
    other: Column = F.col("right" if side == "left" else "left")
    own = pairs.select("left", "right").join(clusters.select(F.col("root").alias(side), "cluster_id", "path"), side)
    there = clusters.select(F.col("root").alias("there"), "cluster_id").distinct()
    return own.join(there, (other == F.col("there")) & (own.cluster_id == there.cluster_id), "left_anti").select("left", "right", "path")


def matched_clusters(clusters: DataFrame, pairs: DataFrame) -> DataFrame:
    """``left, right, cluster_id, level, content_backed, left_files, right_files`` for every cluster two folders share."""
    sizes = clusters.groupBy("root", "cluster_id", "level").agg(F.count("*").alias("files"))
    a = sizes.select(F.col("root").alias("left"), "cluster_id", "level", F.col("files").alias("left_files"))
    b = sizes.select(F.col("root").alias("right"), "cluster_id", F.col("files").alias("right_files"))
    both = pairs.select("left", "right").join(a, "left").join(b, ["right", "cluster_id"])
    return both.select("left", "right", "cluster_id", "level", (~F.col("level").isin("name", "path")).alias("content_backed"), "left_files", "right_files")


def folders_in_order(pairs: DataFrame) -> DataFrame:
    """Folder pairs as a report lists them: the most alike first, by content, then by names."""
    return pairs.orderBy(F.desc("content_similarity"), F.desc("name_similarity"), "left", "right")
