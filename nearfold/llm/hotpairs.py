"""Alike pairs that lost more words to the frequent class than the index bears: combinations of frequent words.

The index of ``combinations`` leaves frequent words out. An item that has words near to such words is
touched; it carries their numbers as labels, and comes under every combination of ``c + 1`` labels,
where ``c`` is what an item of its length bears to lose. A pair that lost more shares such a
combination, for the ``c`` of its shorter item. So a single frequent word brings nothing together
unless one word is all that a short item has; combinations are far rarer. Within the items of one
combination all pairs with such an owner are checked: items are cut into salts, a cell holds two of
these, and its pairs are verified in its task, so only alike pairs leave it. Comparisons grow with
the square of a combination's items; rows sent grow with the square only beyond ``CELL_ITEMS`` per
salt.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import COVERAGE, COVERAGE_PENALTY, flat
from ..operators.combinations import close_words, family, mixed

#: Items of one salt at most, about, and salts that even a small group is cut into so that all slots have work.
CELL_ITEMS, LEAST_SALTS, SMALL_SALT = 8192, 8, 128
#: Bits from which two frames count as far apart in the first look at a pair; rows of either side compared at once.
FAR_BITS, TILE = 16, 256
#: Frequent words up to which each is compared with all words.
FEW_WORDS = 64

Likely = Callable[[np.ndarray, np.ndarray], np.ndarray]


def near_words(words: np.ndarray, hot: np.ndarray, reach: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``words`` and numbers in ``hot`` of all pairs within ``reach`` bits, in the order of places."""
    if len(hot) <= FEW_WORDS:
        found = [np.flatnonzero(np.bitwise_count(words ^ word) <= reach) for word in hot]
        at, which = np.concatenate([np.zeros(0, np.int64), *found]), np.repeat(np.arange(len(hot)), [len(f) for f in found])
    else:
        both, back = np.unique(np.concatenate([words, hot]), return_inverse=True)
        number = np.full(len(both), -1)
        number[back[len(words) :]] = np.arange(len(hot))
        pairs = [np.stack([back[len(words) :]] * 2, 1)]
        for i, j in close_words(both, list(family(len(both), bits, reach)), reach, number >= 0):
            pairs += [np.stack(x, 1)[number[x[1]] >= 0] for x in ((i, j), (j, i))]
        pairs = np.unique(np.concatenate(pairs), axis=0)  # (word, frequent word)
        order = np.argsort(back[: len(words)], kind="stable")
        low = np.searchsorted(back[order], pairs[:, 0], "left")
        count = np.searchsorted(back[order], pairs[:, 0], "right") - low
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at, which = order[np.repeat(low, count) + step], np.repeat(number[pairs[:, 1]], count)
    order = np.lexsort((which, at))
    return at[order], which[order]


def labelled(hot: np.ndarray, reach: int, bits: int):
    """Batches of (id, words, of these: indexed) to those that are touched, with their labels: one per word and frequent word near to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = flat(batch.column(2))
            item = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            at, which = near_words(values[offsets[0] : offsets[-1]], hot, reach, bits)
            rows, counts = np.unique(item[at], return_counts=True)
            if len(rows):
                order = np.lexsort((which, item[at]))
                labels = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(which[order]))
                some = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*some.columns, labels], ["id", "words", "indexed", "labels"])

    return run


def touched_items(items: DataFrame, hot: np.ndarray, reach: int, bits: int) -> DataFrame:
    """``id, words, indexed, labels`` of the items with an indexed word within ``reach`` bits of a frequent one."""
    words = items.schema["words"].dataType.simpleString()
    return items.select("id", "words", "indexed").mapInArrow(labelled(hot, reach, bits), f"id long, words {words}, indexed {words}, labels array<long>")


def combined(labels: list[int], size: int) -> set[int]:
    """Numbers of all combinations of ``size`` labels."""
    few = [x for _, same in itertools.groupby(labels) for x in itertools.islice(same, size)]
    some = np.array(list(itertools.combinations(few, size)), np.uint64).reshape(-1, size)
    number = np.full(len(some), size, np.uint64)
    for column in some.T:
        number = mixed(number * np.uint64(0x9E3779B97F4A7C15) + column + np.uint64(1))
    return set(number.view(np.int64).tolist())


def combinations_of(lost: Callable[[int], int], sizes: set[int]):
    """Batches of touched items to (g, id, owner, words): one row per combination; its owners are items that bear to lose one less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[tuple[int, ...], int], set[int]] = {}
        for batch in batches:
            rows, numbers, owners = [], [], []
            lengths = np.diff(flat(batch.column("indexed"))[1])
            for i, (labels, n) in enumerate(zip(batch.column("labels").to_pylist(), lengths.tolist())):
                own = lost(n) + 1
                for size in sizes:
                    if size <= min(own, len(labels)):
                        key = (tuple(labels), size)
                        if key not in known:
                            if len(known) > 100_000:
                                known.clear()
                            known[key] = combined(labels, size)
                        for number in known[key]:
                            rows.append(i)
                            numbers.append(number)
                            owners.append(size == own)
            some = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers, pa.int64()), some.column("id"), pa.array(owners, pa.bool_()), some.column("words")], ["g", "id", "owner", "words"]
            )

    return run


def combined_items(touched: DataFrame, lost: Callable[[int], int]) -> DataFrame:
    """``g, id, owner, words``: touched items under the combinations of their labels."""
    lengths = [r.n for r in touched.select(F.size("indexed").alias("n")).distinct().collect()]
    words = touched.schema["words"].dataType.simpleString()
    return touched.mapInArrow(combinations_of(lost, {lost(n) + 1 for n in lengths}), f"g long, id long, owner boolean, words {words}")


def frames_needed(shorter: int, least: float, far: int = FAR_BITS) -> int:
    """Frames of the shorter side that must have a frame within ``far - 1`` bits for a score of ``least``."""
    m = np.arange(max(1, int(np.ceil(shorter * COVERAGE))), shorter + 1)
    bits = 64.0 * m * (100.0 - least - COVERAGE_PENALTY * (1.0 - m / shorter)) / 100.0
    return int(np.maximum(0, m - np.floor(bits / far + 1e-9)).min())


def likely_sequences(least: float) -> Likely:
    """A first look at all pairs of two blocks of equally long sequences; false only for pairs below ``least``."""

    def likely(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if a.shape[1] > b.shape[1]:
            return likely(b, a).T
        need = frames_needed(a.shape[1], least)
        close = np.zeros((len(a), len(b)), np.uint16)
        a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
        for frame in a:
            near = np.full(close.shape, 255, np.uint8)
            for other in b:
                np.minimum(near, np.bitwise_count(frame[:, None] ^ other), out=near)
            close += near < FAR_BITS
        return close >= need

    return likely


def _by_length(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tiles of rows of one length: positions and their words as a matrix."""
    sizes = np.diff(offsets)[rows]
    for size in np.unique(sizes):
        same = rows[sizes == size]
        for at in range(0, len(same), TILE):
            some = same[at : at + TILE]
            yield some, values[offsets[some][:, None] + np.arange(size)]


def _ragged(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(offsets)[rows]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return values[np.arange(ends[-1]) + np.repeat(offsets[rows] - ends[:-1], sizes)], ends


def alike_rows(
    values: np.ndarray, offsets: np.ndarray, lefts: np.ndarray, rights: np.ndarray, ids: np.ndarray, owner: np.ndarray,
    alike: Callable, least: float, likely: Likely | None, fresh: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``x, y`` of alike pairs between two sets of rows (or within one), of which a side is an owner and one is fresh."""
    inside, out = lefts is rights, [np.zeros((2, 0), np.int64)]
    if fresh is not None:  # fresh rows share tiles, so that tiles without any are skipped
        lefts, rights = (r[np.argsort(~fresh[r], kind="stable")] for r in (lefts, rights))
    others = list(_by_length(values, offsets, rights))
    for left, a in _by_length(values, offsets, lefts):
        for right, b in others:
            open_ = owner[left][:, None] | owner[right]
            open_ &= ids[left][:, None] < ids[right] if inside else ids[left][:, None] != ids[right]
            if fresh is not None:
                open_ &= fresh[left][:, None] | fresh[right]
            if not open_.any():
                continue
            if likely is not None:
                open_ &= likely(a, b)
            x, y = np.nonzero(open_)
            if len(x):
                x, y = left[x], right[y]
                good = alike(*_ragged(values, offsets, x), *_ragged(values, offsets, y), least)
                out.append(np.stack([x[good], y[good]]))
    return tuple(np.concatenate(out, 1))


def checked_cell(alike: Callable, least: float, likely: Likely | None):
    """One cell's rows (g, i, j, salt, id, owner, words) to its alike pairs of which a side is an owner."""

    def run(cell: pa.Table) -> pa.Table:
        cell = cell.combine_chunks()
        ids, owner, salt = (cell.column(c).to_numpy() for c in ("id", "owner", "salt"))
        values, offsets = flat(cell.column("words").chunk(0))
        i, j = cell.column("i")[0].as_py(), cell.column("j")[0].as_py()
        lefts = np.flatnonzero(salt == i)
        x, y = alike_rows(values, offsets, lefts, lefts if i == j else np.flatnonzero(salt == j), ids, owner, alike, least, likely)
        pairs = np.unique(np.stack([np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])], 1), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def combined_pairs(touched: DataFrame, *, lost: Callable[[int], int], alike: Callable, least: float, likely: Likely | None = None) -> DataFrame:
    """``a, b`` (``a < b``), distinct: alike pairs of touched items that share a combination for the smaller of what they bear to lose."""
    near = combined_items(touched, lost)
    sizes = near.groupBy("g").agg(F.count("*").alias("n"), F.count_if("owner").alias("owners")).where("n > 1 and owners > 0")
    salts = F.greatest(F.ceil(F.col("n") / CELL_ITEMS), F.least(F.lit(LEAST_SALTS), F.ceil(F.col("n") / SMALL_SALT))).cast("int")
    placed = near.join(sizes.select("g", salts.alias("salts")), "g").withColumn("salt", F.pmod(F.xxhash64("id"), "salts").cast("int"))
    cells = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select(
        "g", F.least("salt", "other").alias("i"), F.greatest("salt", "other").alias("j"), "salt", "id", "owner", "words"
    )
    return cells.groupBy("g", "i", "j").applyInArrow(checked_cell(alike, least, likely), "a long, b long").distinct()
