"""Scores for abusive, hateful and sexually explicit text, and rates per source.

The model is a logistic regression over hashed word n-grams and skip-grams, fitted here by
FTRL-proximal: every coordinate has its own learning rate, and L1 keeps most weights at zero, so the
weights that scoring needs are a small broadcast table. Texts are scored by segment (a sentence or
line, long ones in overlapping windows), and a document has the score of its worst segment.

Labels belong to documents and some are wrong. At first every segment of a document
has the document's label; then each part of the sample is judged by a model of the other parts, and
of abusive documents only those segments stay abusive that are found so (the worst one, where
annotators agree). Documents labelled by one annotator in which nothing is found are dropped, and so
are segments of singly labelled harmless documents that are clearly found.

Spelling: look-alikes, characters without width, accents and letter case are brought to one form;
letters set apart by blanks are joined, repeated letters count once, digits and signs among letters
are read as the letters they stand for; a word's letters in any order are a feature of their own.

Defined results: null, empty and blank texts score 0; documents without a usable label are only
scored; without labels of both kinds nothing is learnt and every score is 0; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship_package, stage
from ..operators.combinations import mixed
from .lookalike import skeleton

#: Labelled documents that the model is fitted on, at most; chosen by a hash of their id.
SAMPLE_DOCS = 20_000
#: Words of a segment, and how far the windows of a longer one move.
WINDOW, STEP = 12, 4
#: Distinct words that a task remembers the codes of.
WORDS_KEPT = 1 << 20
#: FTRL-proximal: learning rate, smoothing, L1 and L2; passes over the sample per fit; segments per update.
ALPHA, BETA, L1, L2, PASSES, UPDATE = 0.3, 1.0, 0.3, 2.0, 2, 64
#: Parts of the sample, each judged by a model of the others; what a positive document's segments weigh together at first.
FOLDS, SHARE = 3, 2.0
#: Margin at which a segment of a positive document counts as found while fitting, and the weight of such segments.
FOUND, DOUBT, POSITIVE = -1.0, 3.0, 4.0
#: Score from which a document counts as abusive.
THRESHOLD = 0.5

# Digits and signs read as letters inside words.
SPELT = str.maketrans("013457@$!", "oieastasi")
_APART = regex.compile(r"(?<![\p{L}\p{N}])(?:\p{L}[ .\-_·]){3,}\p{L}(?![\p{L}\p{N}])")
_SEGMENTS = regex.compile(r"[\r\n]+|(?<=[.!?…])[\"'”»“)\]]*\s+")
_WORDS = regex.compile(r"[*#@$_|%+]*[\p{L}\p{N}](?:[\p{L}\p{N}\p{M}*#@$_|%+]|['’!](?=\p{L}))*|[\"'„“”‚‘’«»]")
_MARKS = regex.compile(r"\p{Mn}+")
_REPEATS = regex.compile(r"(.)\1+")
_QUOTES = "\"'„“”‚‘’«»"


def spelt(word: str) -> tuple[str, str]:
    """A word in plain spelling, and the form that forgives swapped and masked letters."""
    if word in _QUOTES:
        return "«", "«"
    if word.isdigit():
        return "0", "0"
    word = word.replace("'", "").replace("’", "").strip("_|+")
    if not word.isalpha():
        word = word.translate(SPELT)
    word = _REPEATS.sub(r"\1", word)
    masked = regex.sub(r"[^\p{L}]+", "*", word)
    if "*" in masked:
        return masked, "*"
    return word, word[:1] + "".join(sorted(word[1:])) if len(word) > 3 else word


class Features:
    """Texts to hashed features by segment."""

    def __init__(self):
        self.seen: dict[str, int] = {}
        self.codes = np.zeros((2, 1024), np.uint64)

    def _learn(self, word: str) -> None:
        self.seen[word] = at = len(self.seen)
        if at == self.codes.shape[1]:
            self.codes = np.concatenate([self.codes, np.zeros_like(self.codes)], axis=1)
        plain, loose = spelt(word)
        self.codes[:, at] = xxhash.xxh64_intdigest(plain), xxhash.xxh64_intdigest("~" + loose)

    def segments(self, text: str | None) -> list[list[str]]:
        if not text:
            return []
        plain = text if text.isascii() else _MARKS.sub("", skeleton(text))
        plain = _APART.sub(lambda m: regex.sub(r"[ .\-_·]", "", m[0]), plain.casefold())
        return [words for part in _SEGMENTS.split(plain) if part and (words := _WORDS.findall(part))]

    def __call__(self, texts: list[str | None]) -> "Occurrences":
        cut = [self.segments(t) for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(x) for x in cut])
        rows = [s for x in cut for s in x]
        lengths = np.array([len(s) for s in rows], np.int64)
        words = [w for s in rows for w in s]
        fresh = set(words).difference(self.seen)
        if len(self.seen) + len(fresh) >= WORDS_KEPT:
            self.seen.clear()
            fresh = set(words)
        for word in sorted(fresh):
            self._learn(word)
        codes = np.array([self.seen[w] for w in words], np.int64)
        plain, loose = self.codes[:, codes]
        row = np.repeat(np.arange(len(rows)), lengths)
        begins = np.cumsum(lengths) - lengths
        place = np.arange(len(codes)) - begins[row]
        found, where, first, last = [plain, loose], [row, row], [place, place], [place, place]
        # runs of two and three words, and pairs with one or two words between; a segment's beginning counts as a word
        edge = np.uint64(0x5851F42D4C957F2D)
        padded, prow, pplace = np.insert(plain, begins, edge), np.insert(row, begins, np.arange(len(rows))), np.insert(place, begins, -1)
        for kind, gaps in enumerate(((1,), (1, 2), (2,), (3,))):
            far = gaps[-1]
            if len(padded) <= far:
                continue
            key = padded[:-far] * np.uint64(2 * kind + 3)
            for gap in gaps:
                key = mixed(key + np.uint64(kind)) + padded[gap : len(padded) - far + gap]
            same = prow[:-far] == prow[far:]
            found.append(key[same])
            where.append(prow[:-far][same])
            first.append(np.maximum(pplace[:-far][same], 0))
            last.append(pplace[far:][same])
        hashes = (mixed(np.concatenate(found)) >> np.uint64(32)).astype(np.uint32)
        return Occurrences(hashes, np.concatenate(where), np.concatenate(first), np.concatenate(last), lengths, owner)


@dataclass
class Occurrences:
    """Features (32 bits) with their segment and their first and last word in it; each segment's words and text."""

    features: np.ndarray
    segment: np.ndarray
    first: np.ndarray
    last: np.ndarray
    lengths: np.ndarray
    owner: np.ndarray

    def windows(self, kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features by window, the window of each, and the text of each window; of ``kept`` occurrences only.

        A segment of up to WINDOW words is one window; a window holds the features that lie within it.
        """
        count = 1 + np.maximum(0, -(-(self.lengths - WINDOW) // STEP))
        base = np.cumsum(count) - count
        segment, first, last = (x if kept is None else x[kept] for x in (self.segment, self.first, self.last))
        features = self.features if kept is None else self.features[kept]
        high = np.minimum(first // STEP, count[segment] - 1)
        low = np.maximum(0, -(-(last + 1 - WINDOW) // STEP))
        times = np.maximum(0, high - low + 1)
        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        window = np.repeat(base[segment] + low, times) + step
        return np.repeat(features, times), window, np.repeat(self.owner, count)


def ftrl(features: np.ndarray, offsets: np.ndarray, labels: np.ndarray, weight: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Weights of ``size`` coordinates; the last is the bias. Segment i has features[offsets[i]:offsets[i+1]]."""
    z, n = np.zeros(size), np.zeros(size)
    order = np.random.default_rng(seed)

    def weights(at: np.ndarray) -> np.ndarray:
        pull = L1 * (at < size - 1)
        return np.where(np.abs(z[at]) <= pull, 0.0, -(z[at] - np.sign(z[at]) * pull) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(PASSES):
        turn = order.permutation(len(labels))
        for i in range(0, len(turn), UPDATE):
            some = turn[i : i + UPDATE]
            sizes = offsets[some + 1] - offsets[some]
            at = np.repeat(offsets[some] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            row = np.repeat(np.arange(len(some)), sizes)
            used, back = np.unique(np.append(features[at], size - 1), return_inverse=True)
            w = weights(used)
            bias = back[-1]
            score = np.bincount(row, w[back[:-1]], len(some)) + w[bias]
            wrong = (1 / (1 + np.exp(-np.clip(score, -35, 35))) - labels[some]) * weight[some]
            g = np.bincount(back[:-1], wrong[row], len(used))
            g[bias] += wrong.sum()
            step = (np.sqrt(n[used] + g * g) - np.sqrt(n[used])) / ALPHA
            z[used] += g - step * w
            n[used] += g * g
    return weights(np.arange(size))


def _taken(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of some rows of a ragged array, and their offsets."""
    sizes = np.diff(offsets)[rows]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return values[np.arange(ends[-1]) + np.repeat(offsets[rows] - ends[:-1], sizes)], ends


def fit(texts: list[str], labels: np.ndarray, votes: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray, float]:
    """Feature hashes with their weights, and the bias, from documents with labels 0 and 1."""
    _, own = np.unique(np.array([xxhash.xxh64_intdigest(t) for t in texts], np.uint64), return_index=True)
    texts, labels, votes = [texts[i] for i in own], labels[own], votes[own]
    nothing = np.zeros(0, np.uint32), np.zeros(0), -10.0
    hashes, row, owner = Features()(texts).windows()
    if not len(owner) or labels.min() == labels.max():
        return nothing
    order = np.argsort(row, kind="stable")
    hashes, row = hashes[order], row[order]
    known, at = np.unique(hashes, return_inverse=True)
    # what one document only holds tells nothing about others
    pairs = np.unique(at * np.int64(len(texts)) + owner[row])
    kept = np.bincount(pairs // len(texts), minlength=len(known)) > 1
    place = np.cumsum(kept) - 1
    row, at, known = row[kept[at]], place[at[kept[at]]], known[kept]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(owner)))])
    size, segments = len(known) + 1, np.arange(len(owner))
    positive, sure = labels[owner] == 1, votes[owner] > 1
    fold = np.random.default_rng(seed).integers(0, FOLDS, len(texts))[owner]
    # at first a label is shared out over the document's segments
    target, weight = positive.astype(float), np.where(positive, np.minimum(1.0, SHARE / np.bincount(owner)[owner]), 1.0)

    def model(rows: np.ndarray, turn: int) -> np.ndarray:
        values, ends = _taken(at, offsets, rows)
        return ftrl(values, ends, target[rows], weight[rows], size, seed + turn)

    for turn in range(2):
        score = np.zeros(len(owner))
        for k in range(FOLDS):  # a segment is judged by a model that did not see its document
            w = model(segments[(fold != k) & (weight > 0)], turn)
            rows = segments[fold == k]
            values, ends = _taken(at, offsets, rows)
            score[rows] = np.bincount(np.repeat(np.arange(len(rows)), np.diff(ends)), w[values], len(rows)) + w[-1]
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, owner, score)
        worst = (score >= best[owner]) & sure
        target = (positive & ((score >= FOUND) | worst)).astype(float)
        weight = np.where(target > 0, POSITIVE, 1.0)
        weight[positive & (best[owner] < FOUND) & ~worst] = 0
        weight[~positive & (score > DOUBT) & ~sure] = 0
    w = model(segments[weight > 0], 2)
    kept = np.flatnonzero(w[:-1])
    return known[kept], w[:-1][kept], float(w[-1])


class Scorer:
    """Worst segment of each text by a table of weights."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float):
        self.hashes, self.weights, self.bias = hashes, weights, bias
        self.features = Features()
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[hashes & np.uint32((1 << 22) - 1)] = True

    def margins(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), -np.inf)
        if not len(self.hashes):
            return out
        found = self.features(texts)
        features, row, owner = found.windows(np.flatnonzero(self.maybe[found.features & np.uint32((1 << 22) - 1)]))
        at = np.minimum(np.searchsorted(self.hashes, features), len(self.hashes) - 1)
        value = np.where(self.hashes[at] == features, self.weights[at], 0.0)
        score = np.bincount(row, value, len(owner)) + self.bias
        np.maximum.at(out, owner, score)
        return out


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    table = pa.Table.from_batches(rows).sort_by("doc")
    hashes, weights, bias = fit(table.column("text").to_pylist(), table.column("label").to_numpy(), table.column("votes").to_numpy())
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(hashes.astype(np.int64), -1)), pa.array(np.append(weights, bias))], ["feature", "weight"]
    )


def fitted(docs: DataFrame, labels: DataFrame, *, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``feature, weight``: the model's weights that are not zero; feature -1 is the bias.

    ``docs`` has doc_id and text, ``labels`` doc_id and abusive. A document's label is what most of
    its annotators said; ties and missing answers do not count.
    """
    votes = labels.where("abusive is not null and doc_id is not null").groupBy("doc_id").agg(
        F.sum(F.when(F.col("abusive") > 0, 1).otherwise(-1)).alias("lean"), F.count("*").alias("votes")
    ).where("lean <> 0")
    votes = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    # the votes are at most sample_docs short rows
    texts = docs.where("text is not null").join(F.broadcast(votes), "doc_id").groupBy("doc_id").agg(
        F.max("text").alias("text"), F.max((F.col("lean") > 0).cast("int")).alias("label"), F.max(F.abs("lean")).alias("votes")
    )
    rows = texts.select(F.col("doc_id").alias("doc"), "text", "label", "votes")
    return rows.repartition(1).mapInArrow(_trained, "feature long, weight double")


def _scored(hashes: np.ndarray, weights: np.ndarray, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(hashes, weights, bias)
        for batch in batches:
            texts, out = batch.column("text"), []
            for at in range(0, len(texts), 500):
                out.append(scorer.margins(texts.slice(at, 500).to_pylist()))
            margin = np.clip(np.concatenate(out), -35, 35)
            score = np.where(margin <= -35, 0.0, 1 / (1 + np.exp(-margin)))
            columns = [c for n, c in zip(batch.schema.names, batch.columns) if n != "text"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(score)], [*(n for n in batch.schema.names if n != "text"), "score"])

    return run


def scored_documents(docs: DataFrame, labels: DataFrame, *, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Every row of ``docs`` (doc_id, source, text) as ``doc_id, source, score``, by a model fitted on ``labels``."""
    ship_package(docs.sparkSession)
    docs = docs.select("doc_id", "source", "text")
    model = stage(fitted(docs.select("doc_id", "text"), labels, sample_docs=sample_docs), "abuse-weights")
    table = sorted((r.feature, r.weight) for r in model.collect())  # at most the sample's features, most of them zero
    bias = table.pop(0)[1] if table else -10.0
    hashes = np.array([f for f, _ in table], np.uint32)
    weights = np.array([w for _, w in table])
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return docs.mapInArrow(_scored(hashes, weights, bias), f"doc_id {kinds['doc_id']}, source {kinds['source']}, score double")


def source_rates(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per source: documents, those at or above the threshold, their share, and the mean score."""
    return scores.groupBy("source").agg(
        F.count("*").alias("documents"), F.count_if(F.col("score") >= threshold).alias("abusive"),
        (F.count_if(F.col("score") >= threshold) / F.count("*")).alias("rate"), F.avg("score").alias("mean_score"),
    )
