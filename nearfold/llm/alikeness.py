"""What alike items must share: bounds that follow from the scores, and the indexes that use them.

Two alike videos match at least 60 % of the frames of the shorter one in order; a bound on all their
differing bits gives a bound on the least of them. With ``m`` of ``n`` frames matched the score allows
``64 m (15 - 20 (1 - m / n)) / 100`` differing bits, so some matched frames differ in at most an m-th of
that: 9 bits where all frames are matched, which leaves only few places (the aligned index), and less
where some are skipped (the shifted index, at any place). A frame of an index of frequent words may be
lost: if at most ``c`` are, the same bits fall on ``m - c`` frames, a somewhat larger distance; if more
are, the pair has a combination of ``c + 1`` frequent words in common.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from ..functions.similarity import AUDIO_OVERLAP, COVERAGE, COVERAGE_PENALTY, alike_sequences, audio_scores, image_scores
from ..operators.combinations import Entries, Index
from .hotpairs import Likely, likely_sequences

#: Scores from which items are alike.
VIDEO_LEAST, IMAGE_LEAST, AUDIO_LEAST = 85.0, 90.0, 94.0
#: Lengths this far from the usual one take part in the aligned index, once per place they may meet.
SPREAD = 6
_SLACK = 1e-6


@dataclass(frozen=True)
class Kind:
    """One kind of fingerprint: its words' bits, the score, and the distances that alike items cannot exceed.

    ``matched(n)`` lists (words matched, bits they may differ in altogether, whether all of the shorter
    is matched) for a shorter side of ``n`` words; ``reach`` is the distance from a frequent word at
    which words count as near to it; at most ``most_lost`` words are borne as lost.
    """

    name: str
    bits: int
    least: float
    alike: Callable
    matched: Callable[[int], list[tuple[int, float, bool]]]
    reach: int
    most_lost: int
    likely: Likely | None = None
    aligned: bool = False

    def distance(self, n: int, lost: int, full: bool | None = None) -> int:
        """Bits within which some pair of words not lost must be; ``full`` takes one sort of matching only."""
        bounds = [b / (m - lost) for m, b, f in self.matched(n) if m > lost and full in (None, f)]
        return min(self.bits, math.floor(max(bounds, default=-1.0) + _SLACK))

    def lost(self, n: int) -> int:
        """Lost words that an item of ``n`` words bears: the distance stays within reach."""
        least = min(m for m, _, _ in self.matched(n))
        return max(c for c in range(self.most_lost + 1) if c == 0 or c < least and self.distance(n, c) <= self.reach)

    def indexes(self, lengths: dict[int, int], hot: np.ndarray, touched: bool) -> list[Index]:
        """Indexes that find every alike pair of items of the given ``lengths`` (with their numbers of items).

        ``touched`` is for items near to frequent words; such pairs may have lost what they bear.
        """
        lengths = {n: c for n, c in lengths.items() if n > 0}
        if not lengths:
            return []
        words = sum(n * c for n, c in lengths.items())
        lost = {n: self.lost(n) if touched else 0 for n in lengths}
        if not self.aligned:
            return [Index(_all(hot), self.bits, max(self.distance(n, lost[n]) for n in lengths), words)]
        usual = max(lengths, key=lambda n: (lengths[n], n))
        near = [n for n in lengths if abs(n - usual) <= SPREAD]
        out = [
            Index(_aligned(hot, usual), self.bits, max(self.distance(n, lost[n], True) for n in near), sum(lengths[n] for n in near), -SPREAD, usual + 2 * SPREAD),
        ]
        shifted = max(self.distance(n, lost[n], False) for n in near)
        if shifted >= 0:
            out.append(Index(_all(hot), self.bits, shifted, words))
        if len(near) < len(lengths):  # the rest against all, at the distance that holds for any length
            out.append(Index(_all(hot, usual), self.bits, max(self.distance(n, lost[n]) for n in lengths), words))
        return out


def _kept(values: np.ndarray, offsets: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words that are not frequent, their rows, places, and the sizes of all rows."""
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(row)) - np.repeat(offsets[:-1] - offsets[0], sizes)
    words = values[offsets[0] : offsets[-1]]
    if len(hot):
        cold = ~np.isin(words, hot)
        words, row, place = words[cold], row[cold], place[cold]
    return words, row, place, sizes


def _all(hot: np.ndarray, usual: int | None = None):
    """All words under one key; with ``usual`` those of items of a length far from it are fresh."""

    def entries(values: np.ndarray, offsets: np.ndarray) -> Entries:
        words, row, _, sizes = _kept(values, offsets, hot)
        fresh = None if usual is None else (np.abs(sizes - usual) > SPREAD)[row]
        return Entries(np.zeros(len(words), np.int64), words, row, fresh)

    return entries


def _aligned(hot: np.ndarray, usual: int):
    """Words under their place, counted from where a sequence of the usual length may begin: all places for other lengths."""

    def entries(values: np.ndarray, offsets: np.ndarray) -> Entries:
        words, row, place, sizes = _kept(values, offsets, hot)
        off = usual - sizes[row]
        near = np.abs(off) <= SPREAD
        words, row, place, off = words[near], row[near], place[near], off[near]
        copies = np.abs(off) + 1
        at = np.repeat(np.arange(len(words)), copies)
        step = np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
        return Entries(place[at] + np.minimum(off, 0)[at] + step, words[at], row[at])

    return entries


def _video_matches(n: int) -> list[tuple[int, float, bool]]:
    return [
        (m, 64.0 * m * (100.0 - VIDEO_LEAST - COVERAGE_PENALTY * (1.0 - m / n)) / 100.0, m == n)
        for m in range(max(1, math.ceil(n * COVERAGE)), n + 1)
    ]


def _audio_matches(n: int) -> list[tuple[int, float, bool]]:
    return [(m, 32.0 * m * (100.0 - AUDIO_LEAST) / 100.0, m == n) for m in range(max(1, int(n * AUDIO_OVERLAP)), n + 1)]


def _image_matches(n: int) -> list[tuple[int, float, bool]]:
    return [(1, 64.0 * (100.0 - IMAGE_LEAST) / 80.0, True)]


def _alike_tracks(lv: np.ndarray, lo: np.ndarray, rv: np.ndarray, ro: np.ndarray, least: float) -> np.ndarray:
    return audio_scores(lv, lo, rv, ro) >= least


def _alike_images(lv: np.ndarray, lo: np.ndarray, rv: np.ndarray, ro: np.ndarray, least: float) -> np.ndarray:
    return image_scores(lv[lo[:-1, None] + np.arange(4)], rv[ro[:-1, None] + np.arange(4)]) >= least


VIDEO = Kind("video", 64, VIDEO_LEAST, alike_sequences, _video_matches, 11, 2, likely_sequences(VIDEO_LEAST), aligned=True)
AUDIO = Kind("audio", 32, AUDIO_LEAST, _alike_tracks, _audio_matches, 2, 2)
IMAGE = Kind("image", 64, IMAGE_LEAST, _alike_images, _image_matches, 8, 0)
