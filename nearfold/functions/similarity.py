"""Similarity of bit fingerprints: column expressions where Catalyst can state them, numpy over pair batches where not.

All scores run from 0 to 100. Words are 64-bit patterns held in signed longs, or 32-bit words held
in longs of 0 to 2**32-1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Longest allowed ratio of two video durations, and difference in seconds.
DURATION_RATIO, DURATION_DELTA = 1.5, 900.0
#: Share of the shorter sequence that must be matched, and points lost per share left out.
COVERAGE, COVERAGE_PENALTY = 0.6, 20.0
#: Frame shifts tried on audio words, the overlap they must keep, bits of a word.
AUDIO_SHIFT, AUDIO_OVERLAP, AUDIO_BITS = 8, 0.9, 32
#: Weights of structure and colour of an image.
STRUCTURE, COLOUR = 0.8, 0.2

_CELLS = 1 << 21


def hamming_distance(left: Column, right: Column) -> Column:
    """Differing bits of two word arrays of equal length; null where a side is null or lengths differ."""
    total = F.aggregate(F.zip_with(left, right, lambda a, b: F.bit_count(a.bitwiseXOR(b)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return F.when(F.size(left) == F.size(right), total)


def hamming_similarity(left: Column, right: Column, bits: int = 64) -> Column:
    """100 for equal arrays, 0 for arrays that are empty, null or of different length."""
    score = F.lit(100.0) * (F.lit(1.0) - hamming_distance(left, right) / (F.size(left) * F.lit(bits)))
    return F.coalesce(F.when(F.size(left) > 0, F.greatest(F.lit(0.0), score)), F.lit(0.0))


def image_similarity(left: Column, right: Column) -> Column:
    """Structure and mean colour of two ``[phash, r, g, b]`` arrays; 0 unless both have four elements."""
    distance = F.bit_count(left[0].bitwiseXOR(right[0]))
    shade = sum((F.abs(left[i] - right[i]) for i in (2, 3)), F.abs(left[1] - right[1]))
    score = F.lit(STRUCTURE) * (F.lit(100.0) * (F.lit(1.0) - distance / F.lit(64.0))) + F.lit(COLOUR) * (
        F.lit(100.0) * (F.lit(1.0) - shade / F.lit(765.0))
    )
    return F.coalesce(F.when((F.size(left) == 4) & (F.size(right) == 4), F.greatest(F.lit(0.0), score)), F.lit(0.0))


def image_scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The same score for pairs of rows ``[phash, r, g, b]`` of two matrices of unsigned words."""
    distance = np.bitwise_count(left[:, 0] ^ right[:, 0])
    shade = np.abs(left[:, 1:].view(np.int64) - right[:, 1:].view(np.int64)).sum(1)
    score = STRUCTURE * (100.0 * (1.0 - distance / 64.0)) + COLOUR * (100.0 * (1.0 - shade / 765.0))
    return np.maximum(0.0, score)


def durations_compatible(left: Column, right: Column, ratio: float = DURATION_RATIO, delta: float = DURATION_DELTA) -> Column:
    """Whether two video durations may belong together; false for null, NaN and durations of 0 or less."""
    low, high = F.least(left, right), F.greatest(left, right)
    known = left.isNotNull() & right.isNotNull() & ~F.isnan(left) & ~F.isnan(right)
    return F.coalesce(known & F.when(low > 0, (high / F.when(low > 0, low) <= ratio) & (high - low <= delta)), F.lit(False))


def flat(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list array of longs, as unsigned words."""
    offsets = array.offsets.to_numpy().astype(np.int64)
    values = array.values.to_numpy(zero_copy_only=False)
    return values.astype(np.int64, copy=False).view(np.uint64), offsets


def _rows(values: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    return values[starts[:, None] + np.arange(width)]


def sequence_scores(lv: np.ndarray, lo: np.ndarray, rv: np.ndarray, ro: np.ndarray) -> np.ndarray:
    """Ordered sequence similarity of each pair of word sequences (values and offsets of either side).

    The best total of exactly m order-preserving matches, for every m from 60 % of the shorter side
    to all of it; the score is the mean of the m less 20 points per share left out.
    """
    ll, rl = np.diff(lo), np.diff(ro)
    scores = np.zeros(len(ll))
    if not len(ll):
        return scores
    shapes = np.stack([ll, rl], 1)
    kinds, which = np.unique(shapes, axis=0, return_inverse=True)
    which = which.ravel()
    for kind, (n, m) in enumerate(kinds):
        shorter = int(min(n, m))
        if not shorter:
            continue
        members = np.flatnonzero(which == kind)
        step = max(1, _CELLS // max(int(n * m), int((m + 1) * (shorter + 1))))
        for at in range(0, len(members), step):
            some = members[at : at + step]
            a, b = _rows(lv, lo[some], n), _rows(rv, ro[some], m)
            frame = 100.0 * (1.0 - np.bitwise_count(a[:, :, None] ^ b[:, None, :]) / 64)
            above = np.full((m + 1, shorter + 1, len(some)), -np.inf)
            above[:, 0] = 0.0
            for i in range(n):
                row = above.copy()
                for j in range(m):
                    np.maximum(row[j + 1], row[j], out=row[j + 1])
                    np.maximum(row[j + 1, 1:], above[j, :-1] + frame[:, i, j], out=row[j + 1, 1:])
                above = row
            counts = np.arange(max(1, int(np.ceil(shorter * COVERAGE))), shorter + 1)[:, None]
            best = (above[m, counts[0, 0] :] / counts - (1.0 - counts / shorter) * COVERAGE_PENALTY).max(0)
            scores[some] = np.clip(best, 0.0, 100.0)
    return scores


def score_bound(lv: np.ndarray, lo: np.ndarray, rv: np.ndarray, ro: np.ndarray) -> np.ndarray:
    """An upper bound of the sequence score: every left frame takes its nearest right frame, in any order."""
    bound = np.zeros(len(lo) - 1)
    shapes, which = np.unique(np.stack([np.diff(lo), np.diff(ro)], 1), axis=0, return_inverse=True)
    for kind, (n, m) in enumerate(shapes):
        if not min(n, m):
            continue
        some = np.flatnonzero(which.ravel() == kind)
        if n < m:  # the shorter side chooses
            a, b = lv[lo[some][:, None] + np.arange(n)], rv[ro[some][:, None] + np.arange(m)]
        else:
            a, b = rv[ro[some][:, None] + np.arange(m)], lv[lo[some][:, None] + np.arange(n)]
        near = np.sort(np.bitwise_count(a[:, :, None] ^ b[:, None, :]).min(2), axis=1).cumsum(1)
        shorter = int(min(n, m))
        counts = np.arange(max(1, int(np.ceil(shorter * COVERAGE))), shorter + 1)
        scores = 100.0 * (1.0 - near[:, counts - 1] / (64.0 * counts)) - (1.0 - counts / shorter) * COVERAGE_PENALTY
        bound[some] = scores.max(1) + 1e-9
    return bound


def may_match(shorter: int, longer: int) -> np.ndarray:
    """Which frames (i of the shorter side, j of the longer) a matching of enough frames in order may pair up."""
    i, j = np.arange(shorter)[:, None], np.arange(longer)
    return np.minimum(i, j) + np.minimum(shorter - 1 - i, longer - 1 - j) + 1 >= max(1, int(np.ceil(shorter * COVERAGE)))


def capped_limit(shorter: int, least: float) -> tuple[int, float]:
    """A cap of bits, and what the sum over all frames of the bits to the nearest frame, capped, cannot exceed at a score of ``least``.

    A match of m frames may differ in some bits altogether; every frame left out adds the cap at most.
    """
    m = np.arange(max(1, int(np.ceil(shorter * COVERAGE))), shorter + 1)
    bits = 64.0 * m * (100.0 - least - COVERAGE_PENALTY * (1.0 - m / shorter)) / 100.0
    cap = 64 if len(m) == 1 else int(np.clip(np.round((bits[-1] - bits[0]) / (m[-1] - m[0])), 0, 64))
    return cap, float((bits + (shorter - m) * cap).max()) + 1e-6


def hopeful_pairs(left: np.ndarray, right: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two matrices of words whose sequences may score ``least``; false only for pairs that cannot."""
    if left.shape[1] > right.shape[1]:
        return hopeful_pairs(right, left, least)[::-1]
    cap, most = capped_limit(left.shape[1], least)
    frames, others = np.ascontiguousarray(left.T), np.ascontiguousarray(right.T)
    shape = (len(left), len(right))
    total, near, count, differing = np.zeros(shape, np.uint16), np.empty(shape, np.uint8), np.empty(shape, np.uint8), np.empty(shape, np.uint64)
    for frame, places in zip(frames, may_match(left.shape[1], right.shape[1])):
        near.fill(cap)
        for j in np.flatnonzero(places):
            np.bitwise_xor(frame[:, None], others[j], out=differing)
            np.bitwise_count(differing, out=count)
            np.minimum(near, count, out=near)
        total += near
    return np.nonzero(total <= most)


def alike_sequences(lv: np.ndarray, lo: np.ndarray, rv: np.ndarray, ro: np.ndarray, least: float) -> np.ndarray:
    """Whether each pair of sequences scores at least ``least``; the exact score only where the bound leaves it open."""
    good = np.zeros(len(lo) - 1, bool)
    for at in range(0, len(good), 8192):
        a, b = lo[at : at + 8193], ro[at : at + 8193]
        open_ = np.flatnonzero(score_bound(lv, a, rv, b) >= least)
        left, right = (some_of(v, o, open_) for v, o in ((lv, a), (rv, b)))
        good[at + open_] = sequence_scores(*left, *right) >= least
    return good


def some_of(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some rows of a ragged array as one of their own."""
    sizes = np.diff(offsets)[rows]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return values[np.arange(ends[-1]) + np.repeat(offsets[rows] - ends[:-1], sizes)], ends


def audio_scores(lv: np.ndarray, lo: np.ndarray, rv: np.ndarray, ro: np.ndarray) -> np.ndarray:
    """Best bit similarity of each pair of 32-bit word sequences over shifts that keep 90 % of the shorter."""
    ll, rl = np.diff(lo), np.diff(ro)
    scores = np.zeros(len(ll))
    order = np.argsort(np.maximum(ll, rl), kind="stable")
    order = order[(ll[order] > 0) & (rl[order] > 0)]
    at = 0
    while at < len(order):
        # as many pairs as fit, by the longest of a chunk
        step = max(1, _CELLS // int(max(ll[order[min(at + 4095, len(order) - 1)]], rl[order[min(at + 4095, len(order) - 1)]])))
        some = order[at : at + min(step, 4096)]
        at += len(some)
        la, lb = ll[some], rl[some]
        width = int(max(la.max(), lb.max()))
        a = np.where(np.arange(width) < la[:, None], lv[np.minimum(lo[some][:, None] + np.arange(width), len(lv) - 1)], 0)
        b = np.where(np.arange(width) < lb[:, None], rv[np.minimum(ro[some][:, None] + np.arange(width), len(rv) - 1)], 0)
        least = np.maximum(1, (np.minimum(la, lb) * AUDIO_OVERLAP).astype(np.int64))
        best = np.zeros(len(some))
        for shift in range(-AUDIO_SHIFT, AUDIO_SHIFT + 1):
            skip_a, skip_b = max(0, shift), max(0, -shift)
            overlap = np.minimum(la - skip_a, lb - skip_b)
            room = width - max(skip_a, skip_b)
            good = overlap >= least
            if room <= 0 or not good.any():
                continue
            bits = np.bitwise_count(a[:, skip_a : skip_a + room] ^ b[:, skip_b : skip_b + room]).astype(np.int64)
            bits[np.arange(room) >= overlap[:, None]] = 0
            score = 100.0 * (1.0 - bits.sum(1) / (np.maximum(overlap, 1) * AUDIO_BITS))
            best = np.where(good, np.maximum(best, score), best)
        scores[some] = best
    return scores


def _scored(kind, left: pa.Array, right: pa.Array) -> pa.Array:
    missing = np.array(left.is_null()) | np.array(right.is_null())
    left, right = (pa.array(x.to_pylist(), x.type).fill_null([]) if x.null_count else x for x in (left, right))
    scores = kind(*flat(left), *flat(right))
    return pa.array(np.where(missing, 0.0, scores))


@F.arrow_udf(T.DoubleType())
def sequence_similarity(left: pa.Array, right: pa.Array) -> pa.Array:
    """Ordered sequence similarity of two columns of 64-bit words; null counts as empty, empty as 0."""
    return _scored(sequence_scores, left, right)


@F.arrow_udf(T.DoubleType())
def audio_similarity(left: pa.Array, right: pa.Array) -> pa.Array:
    """Shift-aligned similarity of two columns of 32-bit words; null counts as empty, empty as 0."""
    return _scored(audio_scores, left, right)
