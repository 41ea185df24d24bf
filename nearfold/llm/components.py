"""Pairs to groups: union-find per edge partition, then a hierarchy of spanning forests.

Level 0 cuts the edges into partitions of bounded size and runs union-find in each; what leaves a
partition is only its spanning forest, written as stars (member -> smallest vertex of its tree), so
a level never emits more rows than it has vertices. The next level merges forests, again in bounded
partitions, until one partition holds everything. A forest that is itself too large for one task is
finished by rounds in which all stars of one member meet (union-find over that bounded partition)
and every star is shortened by one self-join; rounds end when each member has one root only.

Defined results: an edge with a null end is dropped; an edge of a vertex with itself keeps the
vertex as its own group; repeated and swapped edges change nothing; no edges give no rows. Vertices
are compared as bytes (text: by code point) or as numbers. Extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import parts_for, ship_package, slots, stage, unstage

#: Edges that one task takes in: about 300 MB of Python memory with paths of 60 bytes.
EDGES_PER_TASK = 1 << 20


def roots_of(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest vertex of the component of each of ``0..n-1``: hooking roots, then compressing paths."""
    parent = np.arange(n)
    while True:
        a, b = parent[left], parent[right]
        apart = a != b
        if not apart.any():
            return parent
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up


def forest_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over one partition of (member, root) edges; emits its stars, single vertices as own root."""
    left, right = [], []
    for batch in batches:
        left.append(batch.column(0))
        right.append(batch.column(1))
    if not left:
        return
    kind = left[0].type
    if pa.types.is_string(kind):  # 32-bit offsets end at 2 GB
        left, right = ([x.cast(pa.large_string()) for x in side] for side in (left, right))
    coded = pa.chunked_array(left + right).combine_chunks().dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order), dtype=np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    ends = rank[coded.indices.to_numpy()]
    half = len(ends) // 2
    root = roots_of(len(order), ends[:half], ends[half:])
    kept = np.flatnonzero(root != np.arange(len(root)))
    alone = np.setdiff1d(np.flatnonzero(root == np.arange(len(root))), root[kept])
    member, top = np.concatenate([kept, alone]), np.concatenate([root[kept], alone])
    names = coded.dictionary.take(order)
    for at in range(0, len(member), 65536):
        yield pa.RecordBatch.from_arrays(
            [names.take(pa.array(x[at : at + 65536])).cast(kind) for x in (member, top)], ["member", "root"]
        )


def connected_groups(
    edges: DataFrame, left: str = "left", right: str = "right", *, edges_per_task: int = EDGES_PER_TASK
) -> DataFrame:
    """``member, group_key`` for every vertex of ``edges``: the smallest vertex linked to it, itself included."""
    spark = edges.sparkSession
    ship_package(spark)
    pairs = edges.select(F.col(left).alias("member"), F.col(right).alias("root")).where(
        F.col("member").isNotNull() & F.col("root").isNotNull()
    )
    kind = pairs.schema["member"].dataType.simpleString()
    schema = f"member {kind}, root {kind}"
    pairs = stage(pairs, "edges")
    parts = parts_for(pairs.count(), edges_per_task, slots(spark))
    forest = stage(_spread(pairs, parts).mapInArrow(forest_of, schema), "forest")
    unstage(pairs)
    while parts > 1:
        fewer = parts_for(forest.count(), edges_per_task)
        if fewer >= parts:
            forest = _finish(forest, schema, edges_per_task)
            break
        merged = stage(_spread(forest, fewer).mapInArrow(forest_of, schema), "forest")
        unstage(forest)
        forest, parts = merged, fewer
    tops = forest.select(F.col("root").alias("member"), "root").distinct()
    return forest.where("member <> root").unionByName(tops).select("member", F.col("root").alias("group_key"))


def _spread(df: DataFrame, parts: int) -> DataFrame:
    return df.coalesce(1) if parts == 1 else df.repartition(parts)


def _finish(forest: DataFrame, schema: str, edges_per_task: int) -> DataFrame:
    """Rounds over a forest too large for one task: join the stars of a member, shorten every star by a step."""
    while True:
        parts = parts_for(forest.count(), edges_per_task)
        met = stage(forest.repartition(parts, "member").mapInArrow(forest_of, schema).distinct(), "met")
        up = met.where("member <> root").groupBy(F.col("member").alias("root")).agg(F.min("root").alias("above"))
        shorter = met.join(up, "root", "left").select("member", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved"))
        shorter = stage(shorter, "shorter")
        many = shorter.where("member <> root").groupBy("member").agg(F.count_distinct("root").alias("n")).where("n > 1").limit(1)
        open_ends = shorter.where("moved").limit(1).count() + many.count()
        unstage(met)
        unstage(forest)
        forest = shorter.select("member", "root").distinct()
        forest._staged_at = shorter._staged_at
        if not open_ends:
            return forest
