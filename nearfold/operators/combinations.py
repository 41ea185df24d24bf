"""Bit words within a small distance, by combinations of tokens, then a check of the words.

A token is a short run of bits of a word at its place. A family of combinations covers a tolerance if
whatever tokens so many differing bits damage, one combination is left whole; words within the
tolerance then agree on a combination, for certain. Two kinds of family are known: all ``k`` of
``k + t`` tokens, and for larger tolerances the combinations of tokens whose numbers are orthogonal to
a vector over two elements (a covering family, of about half the bits each). The family is chosen by
how many words there are: few short combinations while words are rare, more and longer ones as they
become frequent. It changes the cost only; every family finds the same pairs.

Words that more than HOT_ITEMS items hold form the frequent class. They are left out here and indexed
in combinations of several words instead (see ``llm/hotpairs``).

Entries (a word of an item) travel as packed binary columns, once per group of combinations. A group
goes to one task; beyond ENTRIES_PER_TASK words a group is cut by the bits its combinations share, and
beyond ENTRIES_PER_ROUND entries the groups go one round after the other.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import flat
from ..runtime import ship_package, stage

#: Nanoseconds that one word costs under one combination, and one comparison of two words: they set the family only.
WORD_COST, PAIR_COST = 35.0, 4.0
#: Combinations a family may have at most, and that one group may have.
MOST_COMBINATIONS, GROUP = 1100, 16
#: Entries that one task takes in: 16 bytes each sent, about 60 at the peak.
ENTRIES_PER_TASK = 1 << 22
#: Entries that are on their way at a time, unless two groups have more: 16 bytes each.
ENTRIES_PER_ROUND = 1 << 25
#: A word is frequent when more items than this hold it; the list of such words stays below 2**20 in any case.
HOT_ITEMS = 1000
#: Neighbours compared at a stretch, and pairs held before they are made distinct.
STRETCH, HELD = 1 << 14, 1 << 22
#: Words of either side, and pairs, that are compared at once as a matrix.
SIDE, CELLS = 256, 1 << 16

_ODD = np.uint64(0x9E3779B97F4A7C15)


def subset_family(low: int, width: int, tolerance: int, k: int) -> list[int]:
    """All ``k`` of ``k + tolerance`` tokens of the bits from ``low`` on."""
    edges = [low + round(width * i / (k + tolerance)) for i in range(k + tolerance + 1)]
    tokens = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(some) for some in itertools.combinations(tokens, k)]


def covering_family(low: int, width: int, tolerance: int) -> list[int]:
    """One combination per vector ``v``: the bits whose own vectors are not orthogonal to it.

    Vectors have ``tolerance + 1`` elements, so some ``v`` is orthogonal to the vectors of any
    ``tolerance`` damaged bits, and its combination is whole.
    """
    size = 1 << (tolerance + 1)
    order = np.random.default_rng(tolerance).permutation(size - 1) + 1
    vectors = [int(order[i % (size - 1)]) for i in range(width)]
    return [sum(1 << (low + i) for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, size)]


def family_cost(masks: list[int], words: int) -> float:
    return sum(words * WORD_COST + words * words / 2 / 2.0 ** mask.bit_count() * PAIR_COST for mask in masks)


@lru_cache(256)
def family(words: int, bits: int, tolerance: int) -> tuple[int, ...]:
    """The cheapest family of combinations (as masks) known for so many words that covers ``tolerance`` differing bits.

    The word is cut into parts first: of ``p`` parts whose tolerances and ones add up to
    ``tolerance + 1`` one part is within its tolerance.
    """
    if tolerance >= bits:
        return (0,)
    best: tuple[float, list[int]] = (math.inf, [])
    for parts in range(1, tolerance + 2):
        each = [(tolerance + 1) // parts - 1 + (i < (tolerance + 1) % parts) for i in range(parts)]
        for shares in ([1] * parts, [r + 1 for r in each]):
            edges = [round(bits * s / sum(shares)) for s in itertools.accumulate([0, *shares])]
            masks: list[int] = []
            for low, high, r in zip(edges, edges[1:], each):
                known = [subset_family(low, high - low, r, k) for k in range(1, 9) if k + r <= high - low and math.comb(k + r, k) <= MOST_COMBINATIONS]
                if 2 <= r and 2 << r <= MOST_COMBINATIONS:
                    known.append(covering_family(low, high - low, r))
                if not known:
                    break
                masks += min(known, key=lambda m: family_cost(m, words))
            else:
                cost = family_cost(masks, words)
                if cost < best[0]:
                    best = cost, masks
    return tuple(best[1])


def groups_of(masks: tuple[int, ...], words: int, per_task: int, group: int | None = None) -> list[tuple[list[int], int, int]]:
    """Combinations in groups: (masks, bits that all of them keep, tasks the group is cut into by these bits)."""
    group = group or GROUP
    cuts = math.ceil(words / per_task)
    if cuts <= 1:
        return [(list(masks[at : at + group]), 0, 1) for at in range(0, len(masks), group)]
    need = min(max(m.bit_count() for m in masks), cuts.bit_length() + 3)
    out: list[list] = []
    for mask in masks:
        into = max((g for g in out if (g[1] & mask).bit_count() >= need), key=lambda g: (g[1] & mask).bit_count(), default=None)
        if into is None:
            out.append([[mask], mask])
        else:
            into[0].append(mask)
            into[1] &= mask
    return [(m, shared, cuts) for m, shared in out]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _in_runs(key: np.ndarray, near: Callable[[slice | np.ndarray, slice | np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places of equal sorted keys for which ``near`` holds, a stretch at a time."""
    n = len(key)
    for low in range(0, n, STRETCH):
        high, gap = min(n, low + STRETCH), 1
        left = None
        while True:
            top = min(high, n - gap)
            if left is None:  # many neighbours are in runs yet: slices beat positions
                if top <= low:
                    break
                same = key[low:top] == key[low + gap : top + gap]
                count = int(np.count_nonzero(same))
                if not count:
                    break
                if 4 * count < top - low:
                    left = np.flatnonzero(same) + low
                    hit = left[near(left, left + gap)]
                else:
                    hit = np.flatnonzero(same & near(slice(low, top), slice(low + gap, top + gap))) + low
            else:
                left = left[left + gap < n]
                left = left[key[left] == key[left + gap]]
                if not len(left):
                    break
                hit = left[near(left, left + gap)]
            if len(hit):
                yield hit, hit + gap
            gap += 1


def close_words(words: np.ndarray, masks: list[int], most: int, fresh: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places ``i, j`` of distinct words at most ``most`` bits apart that agree on a combination, once: under the first they agree on.

    With ``fresh`` (a truth value per word) only pairs of which a side is fresh.
    """
    n = len(words)
    if n < 2 or fresh is not None and not fresh.any():
        return
    place = np.uint64(int(n - 1).bit_length())
    low = (np.uint64(1) << place) - np.uint64(1)
    at = np.arange(n, dtype=np.uint64)
    few = fresh is not None and 16 * int(fresh.sum()) < n
    which = np.flatnonzero(fresh) if few else None
    earlier: list[np.uint64] = []
    for mask in map(np.uint64, masks):
        both = (words & mask) * _ODD
        both &= ~low
        both |= at
        if few:  # the others can only meet what is fresh
            head = both >> np.uint64(42)
            met = np.zeros(1 << 22, bool)
            met[head[which]] = True
            both = both[met[head]]
        both.sort()
        order = (both & low).astype(np.int64)
        both >>= place
        some = words[order]
        new = None if fresh is None else fresh[order]

        def near(a, b):
            hit = np.bitwise_count(some[a] ^ some[b]) <= most
            return hit if new is None else hit & (new[a] | new[b])

        for a, b in _in_runs(both, near):
            differing = some[a] ^ some[b]
            own = (differing & mask) == 0  # not keys that only collide
            a, b, differing = a[own], b[own], differing[own]
            for other in earlier:
                if not len(a):
                    break
                new_ = (differing & other) != 0
                if not new_.all():
                    a, b, differing = a[new_], b[new_], differing[new_]
            if len(a):
                yield order[a], order[b]
        earlier.append(mask)


def close_items(
    words: np.ndarray, items: np.ndarray, masks: list[int], most: int, *, equal: bool = True, fresh: np.ndarray | None = None, side: np.ndarray | None = None
) -> Iterator[np.ndarray]:
    """Distinct pairs (rows ``a < b``) of items that hold words at most ``most`` bits apart, in blocks.

    ``items`` are numbers below 2**32. With ``equal`` pairs that hold the same word are found as well.
    With ``fresh`` (a truth value per entry) only pairs of which an entry is fresh, with ``side`` only
    pairs of entries of different sides.
    """
    if not len(words):
        return
    order = np.lexsort((items, words))
    words, items = words[order], items[order]
    fresh, side = (None if x is None else x[order] for x in (fresh, side))
    kept = np.ones(len(words), bool)  # an item counts once per word
    kept[1:] = (words[1:] != words[:-1]) | (items[1:] != items[:-1])
    words, items = words[kept], items[kept].astype(np.uint64)
    fresh, side = (None if x is None else x[kept] for x in (fresh, side))
    starts = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
    counts = np.diff(np.append(starts, len(words)))
    held, size = [], 0

    def code(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        open_ = items[a] != items[b]
        if fresh is not None:
            open_ &= fresh[a] | fresh[b]
        if side is not None:
            open_ &= side[a] != side[b]
        x, y = items[a[open_]], items[b[open_]]
        return np.unique((np.minimum(x, y) << np.uint64(32)) | np.maximum(x, y))

    def blocks() -> Iterator[np.ndarray]:
        if equal:
            for a, b in _in_runs(words, lambda a, b: np.True_ if isinstance(a, slice) else np.ones(len(a), bool)):
                yield code(a, b)
        some = None if fresh is None else np.logical_or.reduceat(fresh, starts)
        for u, v in close_words(words[starts], masks, most, some):
            m = counts[u] * counts[v]
            for part in np.array_split(np.arange(len(u)), max(1, int(m.sum()) // HELD)):
                if len(part) == int(m[part].sum()):
                    yield code(starts[u[part]], starts[v[part]])
                else:
                    which = np.repeat(part, m[part])
                    inner = np.arange(len(which)) - np.repeat(np.cumsum(m[part]) - m[part], m[part])
                    yield code(starts[u[which]] + inner // counts[v[which]], starts[v[which]] + inner % counts[v[which]])

    def pairs(codes: list[np.ndarray]) -> np.ndarray:
        all_ = np.unique(np.concatenate(codes))
        return np.stack([all_ >> np.uint64(32), all_ & np.uint64(0xFFFFFFFF)], 1).astype(np.int64)

    for found in blocks():
        held.append(found)
        size += len(found)
        if size > HELD:
            held = [np.unique(np.concatenate(held))]
            size = len(held[0])
            if 2 * size > HELD:
                yield pairs(held)
                held, size = [], 0
    if size:
        yield pairs(held)


def crossing_family(a: int, b: int, bits: int, tolerance: int) -> tuple[int, ...]:
    """The family for ``crossing_words`` of ``a`` against ``b`` words, where pairs are cheap beside what sorting costs."""
    return family(1 << int(0.7 * a * b / max(1, a + b)).bit_length(), bits, tolerance)


def _rectangles(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For counts of two sides by key: starts and lengths, of either side, of what is compared, each at most SIDE long."""
    first = np.cumsum(a) - a, np.cumsum(b) - b
    key = np.flatnonzero((a > 0) & (b > 0))
    at, left = [f[key] for f in first], [a[key], b[key]]
    for one, other in ((0, 1), (1, 0)):
        cuts = -(-left[one] // SIDE)
        if (cuts > 1).any():
            which = np.repeat(np.arange(len(cuts)), cuts)
            step = (np.arange(len(which)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * SIDE
            at[one], left[one] = at[one][which] + step, np.minimum(left[one][which] - step, SIDE)
            at[other], left[other] = at[other][which], left[other][which]
    return at[0], left[0], at[1], left[1]


def crossing_words(a: np.ndarray, b: np.ndarray, masks: tuple[int, ...], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places ``i`` in ``a`` and ``j`` in ``b`` of words at most ``most`` bits apart that agree on a combination, equal ones too; once or more.

    Words of a side are never compared with each other. Those of one key are compared as a matrix, keys
    of about as many words together.
    """
    if not len(a) or not len(b):
        return
    apart, counted, close = np.empty(CELLS, np.uint64), np.empty(CELLS, np.uint8), np.empty(CELLS + 8, bool)
    grid = np.unique(np.ceil(1.2 ** np.arange(40)).clip(max=SIDE)).astype(np.int64)
    for mask in map(np.uint64, masks):
        sides = []
        for words in (a, b):
            key = ((words & mask) * _ODD >> np.uint64(48)).astype(np.uint16)
            order = np.argsort(key, kind="stable")  # short keys are sorted by their digits
            sides.append((order, words[order], np.bincount(key, minlength=1 << 16)))
        (order_a, some_a, count_a), (order_b, some_b, count_b) = sides
        from_a, len_a, from_b, len_b = _rectangles(count_a, count_b)
        wide, high = np.searchsorted(grid, len_a), np.searchsorted(grid, len_b)
        kinds = wide * len(grid) + high
        sort = np.argsort(kinds, kind="stable")
        for same in np.split(sort, np.flatnonzero(np.diff(kinds[sort])) + 1):
            if not len(same):
                continue
            p, q = int(grid[wide[same[0]]]), int(grid[high[same[0]]])
            per = max(1, CELLS // (p * q))
            for at in range(0, len(same), per):
                some = same[at : at + per]
                x = some_a[np.minimum(from_a[some] + np.arange(p)[:, None], len(a) - 1)]
                y = some_b[np.minimum(from_b[some] + np.arange(q)[:, None], len(b) - 1)]
                k = len(some)
                n = p * q * k
                np.bitwise_xor(x[:, None, :], y[None, :, :], out=apart[:n].reshape(p, q, k))
                np.bitwise_count(apart[:n], out=counted[:n])
                np.less_equal(counted[:n], most, out=close[:n])
                close[n : n + 8] = False
                eight = np.flatnonzero(close[: n + -n % 8].view(np.uint64))  # hits are rare
                if len(eight):
                    hit = (eight[:, None] * 8 + np.arange(8)).ravel()
                    hit = hit[close[hit]]
                    i, j, row = hit // (q * k), hit // k % q, some[hit % k]
                    own = (i < len_a[row]) & (j < len_b[row])
                    i, j, row = i[own], j[own], row[own]
                    yield order_a[from_a[row] + i], order_b[from_b[row] + j]


@dataclass(frozen=True)
class Entries:
    """Entries of one index: a key apart from the word (its place, or 0), the word, the item's row in the batch, whether it is fresh."""

    key: np.ndarray
    word: np.ndarray
    row: np.ndarray
    fresh: np.ndarray | None = None


@dataclass(frozen=True)
class Index:
    """One search: what entries an item has, keys from ``first`` on, words expected per key, and the distance."""

    entries: Callable[[np.ndarray, np.ndarray], Entries]
    bits: int
    most: int
    words: int
    first: int = 0
    keys: int = 1

    def groups(self, per_task: int) -> list[tuple[list[int], int, int]]:
        masks = family(self.words, self.bits, self.most)
        # with keys of their own there are tasks enough without cutting the family
        return groups_of(masks, self.words, per_task, MOST_COMBINATIONS if self.keys > 1 else None)


@dataclass(frozen=True)
class Group:
    """One group of an index in a round: number of its first task, the index, masks, bits they share, cuts, whether it finds equal words."""

    first: int
    index: int
    masks: list[int]
    shared: int
    cuts: int
    equal: bool


def rounds_of(indexes: list[Index], per_task: int, per_round: int) -> list[list[Group]]:
    """The groups of all indexes, in rounds of at most ``per_round`` entries or twice the largest group; a group has ``keys * cuts`` tasks.

    Every group sends all entries of its index, so the groups of a large table send many times its size.
    """
    per_round = max(per_round, 2 * max((x.words * x.keys for x in indexes), default=0))
    rounds, at, sent = [[]], 0, 0
    for i, index in enumerate(indexes):
        for nth, (masks, shared, cuts) in enumerate(index.groups(per_task)):
            entries = index.words * index.keys
            if rounds[-1] and sent + entries > per_round:
                rounds.append([])
                at = sent = 0
            rounds[-1].append(Group(at, i, masks, shared, cuts, nth == 0))
            at += index.keys * cuts
            sent += entries
    return rounds


def _packed(indexes: list[Index], groups: list[Group]):
    """Batches of (id, words) to (task, words, ids, fresh) with packed columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            values, offsets = flat(batch.column(1))
            for i in sorted({g.index for g in groups}):
                index = indexes[i]
                got = index.entries(values, offsets)
                if not len(got.word):
                    continue
                key = np.clip(got.key - index.first, 0, index.keys - 1)
                for group in groups:
                    if group.index != i:
                        continue
                    task = key * group.cuts
                    if group.cuts > 1:
                        task += (mixed(got.word & np.uint64(group.shared)) % np.uint64(group.cuts)).astype(np.int64)
                    if index.keys * group.cuts <= 1 << 16:  # small numbers are sorted by their digits
                        task = task.astype(np.uint16)
                    order = np.argsort(task, kind="stable")
                    out: list[tuple[int, bytes, bytes, bytes | None]] = []
                    for some in np.split(order, np.flatnonzero(np.diff(task[order])) + 1):
                        flags = None if got.fresh is None else got.fresh[some].tobytes()
                        out.append((group.first + int(task[some[0]]), got.word[some].tobytes(), ids[got.row[some]].tobytes(), flags))
                    for at in range(0, len(out), 1024):
                        columns = zip(zip(*out[at : at + 1024]), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], ["task", "words", "ids", "fresh"])

    return run


def _joined(indexes: list[Index], groups: list[Group]):
    """Each task's entries to distinct pairs of ids."""
    firsts = [g.first for g in groups]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list[tuple[bytes, bytes, bytes | None]]] = {}
        for batch in batches:
            for task, *entry in zip(*(batch.column(c).to_pylist() for c in range(4))):
                got.setdefault(task, []).append(tuple(entry))
        for task in sorted(got):
            words, ids, fresh = zip(*got.pop(task))
            group = groups[int(np.searchsorted(firsts, task, "right")) - 1]
            names, items = np.unique(np.frombuffer(b"".join(ids), np.int64), return_inverse=True)
            flags = None if fresh[0] is None else np.frombuffer(b"".join(fresh), bool)
            for pairs in close_items(np.frombuffer(b"".join(words), np.uint64), items, group.masks, indexes[group.index].most, equal=group.equal, fresh=flags):
                yield pa.RecordBatch.from_arrays([pa.array(names[pairs[:, 0]]), pa.array(names[pairs[:, 1]])], ["a", "b"])

    return run


def frequent_words(items: DataFrame, words: int) -> np.ndarray:
    """Words held by more than HOT_ITEMS items; the limit rises with the data so that the list stays short."""
    limit = max(HOT_ITEMS, words >> 20)
    found = items.select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").count().where(F.col("count") > limit)
    return np.sort(np.array([r.w for r in found.select("w").collect()], dtype=np.int64).view(np.uint64))


def combination_pairs(items: DataFrame, indexes: list[Index], *, per_task: int = ENTRIES_PER_TASK, per_round: int = ENTRIES_PER_ROUND) -> DataFrame:
    """``a, b`` (``a < b``), distinct: pairs of items of which two entries of one index and key are within its distance.

    ``items`` has ``id`` (long, unique) and ``words`` (array of longs without nulls). No such pair is missed.

    One round is left to the plan it becomes part of. Where there are several, each is staged before the
    next begins, which frees the disk that its entries took: at no time more than a round's are there.
    """
    ship_package(items.sparkSession)

    def pairs_of(groups: list[Group]) -> DataFrame:
        parts = max(1, sum(indexes[g.index].keys * g.cuts for g in groups))
        entries = items.select("id", "words").mapInArrow(_packed(indexes, groups), "task int, words binary, ids binary, fresh binary")
        return entries.repartitionById(parts, F.col("task")).mapInArrow(_joined(indexes, groups), "a long, b long").distinct()

    rounds = rounds_of(indexes, per_task, per_round)
    if len(rounds) == 1:
        return pairs_of(rounds[0])
    return reduce(DataFrame.union, [stage(pairs_of(groups), "pairs-round") for groups in rounds]).distinct()
