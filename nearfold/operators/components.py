"""Connected components by alternating star contractions, all in joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import stage, unstage


def components(edges: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
    """``node, component`` (the smallest node) for every end of an edge; null ends are dropped.

    Large-star, then small-star, until an iteration changes nothing: each points nodes at the smallest
    neighbour, so trees flatten in a logarithmic number of rounds and no neighbourhood is ever collected.
    """
    pairs = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where(F.col(left).isNotNull() & F.col(right).isNotNull())
    pairs = stage(pairs.distinct(), "stars")
    alone = pairs.where("u = v").select(F.col("u").alias("node"))
    forest = pairs.where("u <> v")
    state = None
    while True:
        both = forest.union(forest.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).where("u <> v").distinct()
        done = stage(small, "stars")
        now = done.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        unstage(forest)
        forest = done
        if now == state:
            break
        state = now
    roots = forest.select(F.col("v").alias("node")).union(alone.join(forest, F.col("node") == F.col("u"), "left_anti")).distinct()
    return forest.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
