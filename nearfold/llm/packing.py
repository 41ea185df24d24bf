"""Items of uneven length into containers of one capacity, by linear grouping.

What is planned is the histogram of lengths, at most one row per length up to the capacity, whatever
the number of items. Lengths above a quarter of the capacity are large: sorted downwards they are
cut into groups of equal cardinality, each rounded up to its largest; for these few sizes container
configurations are optimised (cutting-stock program by column generation). The actual items then
take the places of their group by rank, so a container is never fuller than planned. Small items go
best-fit, largest first, into the room actually left: containers with equal room are one class, and
the plan moves whole runs of containers between classes. Ranks come from salted counts, so no task
sorts all items of one length.

Defined results: an item longer than the capacity is cut into full containers and a rest; one that
fits is never cut. Items of length 0 (null and empty texts) come out with piece 0 and no container.
Repeated rows are items of their own.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import parts_for, stage

#: Groups that large lengths are rounded to, and the share of the capacity above which a length is large.
GROUPS, LARGE_SHARE = 80, 4
#: Items that are ranked by one task.
ROWS_PER_SALT = 1 << 20


def best_configuration(value: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Copies of each size that fit the capacity with the highest total value."""
    best, picks = np.zeros(capacity + 1), []
    for v, s in zip(value, sizes):
        now, took = best.copy(), np.zeros(capacity + 1, np.int64)
        if v > 1e-12:
            for copies in range(1, capacity // s + 1):
                other = best[: capacity + 1 - copies * s] + copies * v
                better = other > now[copies * s :] + 1e-12
                now[copies * s :][better] = other[better]
                took[copies * s :][better] = copies
        best = now
        picks.append(took)
    room, chosen = int(np.argmax(best)), np.zeros(len(sizes), np.int64)
    top = float(best[room])
    for i in range(len(sizes) - 1, -1, -1):
        chosen[i] = picks[i][room]
        room -= chosen[i] * sizes[i]
    return top, chosen


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations and how often each is used, together holding every item of ``counts``."""
    n = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(60 * n):
        inverse = np.linalg.inv(basis)
        price = inverse.sum(0)
        value, column = best_configuration(price, sizes, capacity)
        if value <= 1 + 1e-9:
            break
        use, step = inverse @ counts, inverse @ column
        ratio = np.where(step > 1e-9, use / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    left, plan = counts.astype(np.int64).copy(), []
    for column, times in zip(np.rint(basis.T).astype(np.int64), np.linalg.solve(basis, counts)):
        times = int(max(0, np.floor(times + 1e-9)))
        some = column > 0
        times = min([times, *(left[some] // column[some])])
        if times > 0:
            plan.append((column, int(times)))
            left -= times * column
    while left.any():  # what rounding left over, fewer items than configurations can hold
        column, room = np.zeros(n, np.int64), capacity
        for i in range(n):
            column[i] = min(left[i], room // sizes[i])
            room -= column[i] * sizes[i]
        some = column > 0
        times = int((left[some] // column[some]).min())
        plan.append((column, times))
        left -= times * column
    return plan


def plan_large(lengths: dict[int, int], capacity: int, groups: int = GROUPS) -> tuple[np.ndarray, int]:
    """Runs (rank from, first container, items per container) over large items ranked from the longest; containers used."""
    full = lengths.get(capacity, 0)
    runs, used = ([(0, 0, 1)] if full else []), full
    sizes = np.array(sorted((s for s in lengths if s < capacity), reverse=True), np.int64)
    if not len(sizes):
        return np.array(runs, np.int64).reshape(-1, 3), used
    counts = np.array([lengths[s] for s in sizes])
    ends = np.cumsum(counts)
    cuts = np.unique(np.linspace(0, ends[-1], min(groups, ends[-1]) + 1).astype(np.int64))
    # a group is rounded up to the length of its first item; groups of one length are one
    tops = sizes[np.searchsorted(ends, cuts[:-1], "right")]
    kept = np.concatenate([[True], tops[1:] != tops[:-1]])
    tops, starts = tops[kept], cuts[:-1][kept]
    held = np.diff(np.append(starts, ends[-1]))
    at = full + starts
    for column, times in configurations(tops, held, capacity):
        for g in np.flatnonzero(column):
            runs.append((int(at[g]), used, int(column[g])))
            at[g] += column[g] * times
        used += times
    return np.array(sorted(runs), np.int64), used


def plan_small(lengths: dict[int, int], rooms: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Runs (rank from, room class, first container of the class, items per container) over small items ranked from the longest.

    Room class 0 stands for new containers; their number comes second.
    """
    classes: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    open_rooms: list[int] = []

    def put(room: int, piece: tuple[int, int, int]) -> None:
        if room > 0 and piece[2]:
            if not classes[room]:
                insort(open_rooms, room)
            classes[room].append(piece)

    for room, n in rooms.items():
        put(room, (room, 0, n))
    runs, rank, fresh = [], 0, 0
    for size in sorted(lengths, reverse=True):
        left = lengths[size]
        while left:
            i = bisect_left(open_rooms, size)
            if i == len(open_rooms):
                more = -(-left // (capacity // size))
                put(capacity, (0, fresh, more))
                fresh += more
                continue
            room = open_rooms[i]
            origin, low, n = classes[room].pop()
            if not classes[room]:
                open_rooms.pop(i)
            per = min(room // size, left)
            take = min(n, left // per)
            runs.append((rank, origin, low, per))
            rank += take * per
            left -= take * per
            put(room, (origin, low + take, n - take))
            put(room - per * size, (origin, low, take))
    return np.array(runs, np.int64).reshape(-1, 4), fresh


def ranked(df: DataFrame, by: str, order: str, rows: int, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """``df`` with ``rank``: 0, 1, ... within each value of ``by``; rows of one value are numbered by many tasks."""
    salts = parts_for(rows, rows_per_salt)
    salted = df.withColumn("salt", F.pmod(F.xxhash64(order), F.lit(salts)).cast("int"))
    sizes = salted.groupBy(by, "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(by).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(by, "salt", F.coalesce(before, F.lit(0)).alias("start"))
    local = F.row_number().over(Window.partitionBy(by, "salt").orderBy(order)) - 1
    return salted.withColumn("local", local).join(starts, [by, "salt"]).withColumn("rank", F.col("local") + F.col("start")).drop("local", "start", "salt")


def _looked_up(runs: np.ndarray, columns: int):
    """Arrow function: global rank to the columns of its run, the last with the container counted on."""
    kind = T.StructType([T.StructField(f"c{i}", T.LongType()) for i in range(columns)])

    @F.arrow_udf(kind)
    def look(ranks: pa.Array) -> pa.Array:
        rank = np.asarray(ranks)
        run = runs[np.searchsorted(runs[:, 0], rank, "right") - 1] if len(runs) else np.zeros((len(rank), runs.shape[1]), np.int64)
        place = run[:, -2] + (rank - run[:, 0]) // np.maximum(run[:, -1], 1)
        fields = [run[:, 1], place][-columns:]
        return pa.StructArray.from_arrays([pa.array(x) for x in fields], [f"c{i}" for i in range(columns)])

    return look


def packed_items(items: DataFrame, key: str, length: str, capacity: int = 2048, *, groups: int = GROUPS) -> DataFrame:
    """``key, piece, start, tokens, container, offset``: every item's pieces and where they lie.

    ``start`` is where the piece begins in its item, ``offset`` where it begins in its container.
    """
    sized = stage(items.select(F.col(key).alias("key"), F.coalesce(F.col(length), F.lit(0)).cast("long").alias("n")), "pack-items")
    size, count = F.col("n"), F.ceil(F.col("n") / F.lit(capacity)).cast("int")
    pieces = sized.where("n > 0").select("key", "n", F.explode(F.sequence(F.lit(0), count - 1)).alias("piece"))
    pieces = pieces.select("key", "piece", F.least(size - F.col("piece").cast("long") * capacity, F.lit(capacity)).cast("int").alias("tokens"))
    pieces = pieces.withColumn("pid", F.struct("key", "piece"))
    histogram = {r.tokens: r.n for r in pieces.groupBy("tokens").agg(F.count("*").alias("n")).collect()}
    least = capacity // LARGE_SHARE
    large = {s: n for s, n in histogram.items() if s > least}
    small = {s: n for s, n in histogram.items() if s <= least}
    runs, containers = plan_large(large, capacity, groups)

    def placed(sizes: dict[int, int], condition: str) -> DataFrame:
        order = sorted(sizes, reverse=True)
        starts = dict(zip(order, np.concatenate([[0], np.cumsum([sizes[s] for s in order])])[:-1].tolist()))
        before = items.sparkSession.createDataFrame([(s, n) for s, n in starts.items()], "tokens int, before long")
        some = ranked(pieces.where(condition), "tokens", "pid", sum(sizes.values()))
        return some.join(F.broadcast(before), "tokens").withColumn("rank", F.col("rank") + F.col("before")).drop("before", "pid")

    packed = placed(large, f"tokens > {least}").withColumn("container", _looked_up(runs, 1)("rank").getField("c0")).drop("rank")
    packed = stage(packed.select("key", "piece", "tokens", "container"), "pack-large")
    rooms = packed.groupBy("container").agg((F.lit(capacity) - F.sum("tokens")).cast("int").alias("room")).where("room > 0")
    rooms = stage(ranked(rooms, "room", "container", containers), "pack-rooms")
    classes = {r.room: r.n for r in rooms.groupBy("room").agg(F.count("*").alias("n")).collect()}
    runs, _ = plan_small(small, classes, capacity)
    filled = placed(small, f"tokens <= {least}").withColumn("at", _looked_up(runs, 2)("rank")).select(
        "key", "piece", "tokens", F.col("at.c0").alias("room"), F.col("at.c1").alias("place")
    )
    old = filled.where("room > 0").join(
        rooms.select(F.col("room").cast("long").alias("room"), F.col("rank").alias("place"), "container"), ["room", "place"]
    ).select("key", "piece", "tokens", "container")
    new = filled.where("room = 0").select("key", "piece", "tokens", (F.col("place") + F.lit(containers)).alias("container"))
    packed = packed.union(old).union(new)
    # a container holds at most as many pieces as its capacity
    before = Window.partitionBy("container").orderBy(F.desc("tokens"), "key", "piece").rowsBetween(Window.unboundedPreceding, -1)
    packed = packed.withColumn("offset", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("int"))
    empty = sized.where("n <= 0").select("key", F.lit(0).alias("piece"), F.lit(0).alias("tokens"), F.lit(None).cast("long").alias("container"), F.lit(None).cast("int").alias("offset"))
    packed = packed.union(empty)
    start = F.col("piece").cast("long") * capacity
    return packed.select(F.col("key").alias(key), "piece", start.alias("start"), "tokens", "container", "offset")
