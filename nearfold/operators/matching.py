"""Similarity joins over media fingerprints, each as an equi-join on blocks or bands with an exact check after it."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import (
    DURATION_DELTA,
    DURATION_RATIO,
    audio_similarity,
    durations_compatible,
    flat,
    hopeful_pairs,
    image_similarity,
    score_bound,
    sequence_scores,
    sequence_similarity,
    some_of,
)
from ..runtime import ship_package, slots, stage
from .combinations import Entries, Index, combination_pairs

IMAGE_THRESHOLD, VIDEO_THRESHOLD, AUDIO_THRESHOLD = 90.0, 85.0, 94.0
AUDIO_SECONDS = 3.0
#: Bits up to which words of audio tracks are looked up by masks; beyond, tracks of about one duration are all compared.
AUDIO_KEYED = 3
#: Scores worth a second look by realignment, and the durations between which it may help.
RECHECK_FROM, RECHECK_MIN_DELTA, RECHECK_MAX_DELTA = 65.0, 0.05, 180.0


def differs(left: str, right: str) -> Column:
    """True unless both hashes are known and equal."""
    return ~F.coalesce(F.col(left) == F.col(right), F.lit(False))


def sides_of(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both frames with their side appended to every column name."""
    return left.toDF(*(f"{c}_a" for c in left.columns)), right.toDF(*(f"{c}_b" for c in right.columns))


def sides(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return sides_of(df, df)


#: Most keys that a word is given: so many rows it becomes.
MOST_KEYS = 200


def kept_bits(bits: int, distance: int, words: int) -> list[int]:
    """Masks of which one leaves out all differing bits of two words within ``distance``: all choices of k of k + distance runs of bits.

    ``k`` weighs the rows that words become against the pairs that agree on a mask by chance.
    """

    def masks(k: int) -> list[int]:
        cuts = np.linspace(0, bits, k + distance + 1).round().astype(int).tolist()
        runs = [(1 << high) - (1 << low) for low, high in zip(cuts, cuts[1:])]
        return [sum(some) for some in combinations(runs, k)]

    def cost(k: int) -> float:
        return comb(k + distance, k) * words * (1 + words / 2 ** (bits * k / (k + distance)))

    known = [k for k in range(1, 7) if k + distance <= bits and comb(k + distance, k) <= MOST_KEYS]
    best = min(known, key=cost, default=None)
    return [0] if best is None or cost(best) > words * (1 + words) else masks(best)


def masked_keys(word: Column, masks: list[int]) -> Column:
    """One (mask, bits kept) per mask; words of no mask in common differ in more bits than the masks allow."""
    return F.array(*(F.struct(F.lit(i).alias("i"), word.bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("long")).alias("v")) for i, m in enumerate(masks)))


def near_pairs(rows: DataFrame, word: Column, masks: list[int]) -> DataFrame:
    """``ord_a, ord_b`` (``ord_a < ord_b``), distinct: rows that agree on a mask; only ids and keys are joined."""
    keyed = rows.select("ord", F.explode(masked_keys(word, masks)).alias("key")).select("ord", "key.i", "key.v").distinct()
    a, b = sides(keyed)
    same = (F.col("i_a") == F.col("i_b")) & (F.col("v_a") == F.col("v_b")) & (F.col("ord_a") < F.col("ord_b"))
    return a.join(b, same).select("ord_a", "ord_b").distinct()


def structure_distance(threshold: float) -> int:
    """Bits in which the hashes of two images of one colour may differ at a similarity threshold."""
    return int(np.floor(64 * (1 - (threshold - 20.0) / 80.0) + 1e-9))


def _first_words(values: np.ndarray, offsets: np.ndarray) -> Entries:
    """Items of one word each, all under one key."""
    words = values[offsets[0] : offsets[-1]]
    return Entries(np.zeros(len(words), np.int64), words, np.arange(len(words)))


def image_matches(files: DataFrame, threshold: float = IMAGE_THRESHOLD) -> DataFrame:
    """``ord_a, ord_b, similarity`` of files with alike images, ``ord_a < ord_b``; byte-identical pairs are left out.

    Equal images are one kind. Kinds whose hashes are near are found by combinations of bits in the tasks
    that hold them, so what is shuffled follows the images and the pairs found, not the pairs tried.
    """
    images = files.where("size(image_fingerprint) = 4 and not exists(image_fingerprint, w -> w is null)")
    if threshold > 100:
        return images.selectExpr("ord as ord_a", "ord as ord_b", "0.0D as similarity").where("false")
    own = F.coalesce(F.concat(F.lit("h"), "full_hash"), F.concat(F.lit("o"), F.col("ord").cast("string")))
    images = images.select("ord", F.col("image_fingerprint").alias("words"), own.alias("own"))
    several = (F.count("*") > 1) & (F.min("own") < F.max("own"))
    kinds = stage(images.groupBy("words").agg(F.min("ord").alias("id"), several.alias("several")), "image-kinds")
    index = Index(_first_words, 64, min(64, structure_distance(threshold)), kinds.count())
    a, b = kinds.select(F.col("id").alias("a"), F.col("words").alias("words_a")), kinds.select(F.col("id").alias("b"), F.col("words").alias("words_b"))
    near = combination_pairs(kinds.select("id", F.slice("words", 1, 1).alias("words")), [index]).join(a, "a").join(b, "b")
    scored = near.select("a", "b", image_similarity(F.col("words_a"), F.col("words_b")).alias("similarity")).where(F.col("similarity") >= threshold)
    scored = stage(scored.union(kinds.where("several").select("id", "id", F.lit(100.0))), "image-kind-pairs")
    used = kinds.join(scored.select(F.col("a").alias("id")).union(scored.select("b")).distinct(), "id", "left_semi")
    members = stage(images.join(used.select("words", "id"), "words").select("id", "own", "ord"), "image-members")
    # rows of one kind and one content never pair up: they are one unit until pairs are known
    units = members.groupBy("id", "own").agg(F.min("ord").alias("unit"))
    between = scored.join(units.toDF("a", "own_a", "unit_a"), "a").join(units.toDF("b", "own_b", "unit_b"), "b")
    between = between.where("own_a <> own_b and (a <> b or unit_a < unit_b)").select("unit_a", "unit_b", "similarity")
    rows = members.join(units, ["id", "own"]).select("unit", "ord")
    found = between.join(rows.toDF("unit_a", "x"), "unit_a").join(rows.toDF("unit_b", "y"), "unit_b")
    return found.select(F.least("x", "y").alias("ord_a"), F.greatest("x", "y").alias("ord_b"), "similarity")


def banded(left: DataFrame, right: DataFrame, band: Column, exact: Column, salts: int = 1) -> DataFrame:
    """Pairs of rows whose bands are neighbours and that satisfy ``exact``; ``band`` reads column ``duration``.

    Few or hot bands are cut into ``salts`` parts by the right rows; each left row goes to every part.
    """
    left = left.withColumns({"band": F.explode(F.array(band - 1, band, band + 1))}).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    near = right.withColumns({"band": band, "salt": F.pmod(F.xxhash64("ord"), F.lit(salts)).cast("int")})
    (a, b), keys = sides_of(left, near), ("band", "salt")
    same = (F.col("band_a") == F.col("band_b")) & (F.col("salt_a") == F.col("salt_b"))
    return a.join(b, same & exact).drop(*(f"{k}_{s}" for k in keys for s in "ab"))


def audio_matches(files: DataFrame, threshold: float = AUDIO_THRESHOLD, seconds: float = AUDIO_SECONDS) -> DataFrame:
    """``ord_a, ord_b, similarity`` of files with alike audio tracks of about one duration."""
    tracks = files.where("size(audio_fingerprint) > 0 and duration is not null and not isnan(duration)")
    tracks = tracks.select("ord", "full_hash", "duration", F.col("audio_fingerprint").alias("words"))
    near = (F.abs(F.col("duration_a") - F.col("duration_b")) <= seconds) & (F.col("ord_a") < F.col("ord_b")) & differs("full_hash_a", "full_hash_b")
    distance = int(np.floor(32 * (1 - threshold / 100.0) + 1e-9))
    if 0 <= distance <= AUDIO_KEYED:  # some words of alike tracks are that near: they lead to the pairs
        words = tracks.select("ord", F.explode(F.array_distinct("words")).alias("word"))
        a, b = sides(tracks)
        pairs = near_pairs(words, F.col("word"), kept_bits(32, distance, words.count())).join(a, "ord_a").join(b, "ord_b").where(near)
    else:
        pairs = banded(tracks, tracks, F.floor(F.col("duration") / seconds), near)
    score = audio_similarity(F.col("words_a"), F.col("words_b"))
    return pairs.select("ord_a", "ord_b", score.alias("similarity")).where(F.col("similarity") >= threshold)


def video_band(duration: Column) -> Column:
    """Bands a little wider than the longest allowed ratio, so that compatible durations lie in neighbouring ones."""
    return F.floor(F.ln(duration) / F.lit(float(np.log(1.51))))


def videos(files: DataFrame) -> DataFrame:
    usable = files.where("size(fingerprint) > 0 and fingerprint_version = 2 and duration > 0 and not isnan(duration)")
    return usable.select("ord", "full_hash", "duration", F.col("fingerprint").alias("words"))


def video_candidates(queries: DataFrame, rows: DataFrame, *, once: bool = False) -> DataFrame:
    """Pairs of a query video and any other video of compatible duration, byte-identical ones left out.

    ``once`` is for a table against itself: of a pair only the side with the smaller ord is the query.
    """
    order = F.col("ord_a") < F.col("ord_b") if once else F.col("ord_a") != F.col("ord_b")
    exact = durations_compatible(F.col("duration_a"), F.col("duration_b")) & order & differs("full_hash_a", "full_hash_b")
    # there are only some ten bands of videos, and most videos are in one of them
    return banded(queries, rows, video_band(F.col("duration")), exact, slots(rows.sparkSession))


#: Videos of either side that meet in one task, at most about; of these compared at once.
CELL_VIDEOS, TILE_LEFT, TILE_RIGHT = 16_384, 64, 1024
SCORED = "ord_a long, ord_b long, delta double, similarity double"


def _tiles(words: tuple[np.ndarray, np.ndarray], durations: np.ndarray, rows: np.ndarray, step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of one length and about one duration, and their words as a matrix."""
    values, offsets = words
    sizes = np.diff(offsets)[rows]
    for size in np.unique(sizes):
        same = rows[sizes == size]
        same = same[np.argsort(durations[same], kind="stable")]
        for at in range(0, len(same), step):
            some = same[at : at + step]
            yield some, values[offsets[some][:, None] + np.arange(size)]


def scored_cell(least: float, once: bool):
    """One cell's queries and rows (side, ord, full_hash, duration, words) to its pairs of at least ``least``.

    Pairs are never rows of a table: words are compared as matrices, and what is left after a bound is scored.
    """

    def run(cell: pa.Table) -> pa.Table:
        cell = cell.combine_chunks()
        side, ord_, duration = (cell.column(c).to_numpy() for c in ("side", "ord", "duration"))
        known = cell.column("full_hash").combine_chunks()
        known = known.chunk(0) if isinstance(known, pa.ChunkedArray) else known
        content = known.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        words = flat(cell.column("words").chunk(0))
        rights = list(_tiles(words, duration, np.flatnonzero(side == 1), TILE_RIGHT))
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for x, a in _tiles(words, duration, np.flatnonzero(side == 0), TILE_LEFT):
            for y, b in rights:
                lows, highs = (duration[x[0]], duration[y[0]]), (duration[x[-1]], duration[y[-1]])
                apart = max(lows) - min(highs)
                if apart > DURATION_DELTA or max(lows) / min(highs) > DURATION_RATIO:
                    continue
                i, j = hopeful_pairs(a, b, least)
                i, j = x[i], y[j]
                low, high = np.minimum(duration[i], duration[j]), np.maximum(duration[i], duration[j])
                good = (high / low <= DURATION_RATIO) & (high - low <= DURATION_DELTA) & ((content[i] != content[j]) | (content[i] < 0))
                good &= ord_[i] < ord_[j] if once else ord_[i] != ord_[j]
                i, j = i[good], j[good]
                good = score_bound(*some_of(*words, i), *some_of(*words, j)) >= least
                i, j = i[good], j[good]
                score = sequence_scores(*some_of(*words, i), *some_of(*words, j))
                good = score >= least
                out.append((i[good], j[good], score[good]))
        i, j, score = (np.concatenate(c) for c in zip(*out))
        return pa.table({"ord_a": ord_[i], "ord_b": ord_[j], "delta": np.abs(duration[i] - duration[j]), "similarity": score})

    return run


def scored_videos(queries: DataFrame, rows: DataFrame, least: float, *, once: bool = False) -> DataFrame:
    """``ord_a, ord_b, delta, similarity`` of the pairs of ``video_candidates`` that score at least ``least``.

    A cell holds some rows of a band and some queries of it and its neighbours; bands are cut by how many they are.
    """
    band = video_band(F.col("duration"))
    counts = queries.select(band.alias("band"), F.lit(0).alias("side")).union(rows.select(band.alias("band"), F.lit(1).alias("side"))).groupBy("band", "side").count().collect()
    asked, there = ({r.band: r["count"] for r in counts if r.side == side} for side in (0, 1))  # some ten bands
    near = {b: sum(asked.get(b + d, 0) for d in (-1, 0, 1)) for b in there}
    cuts = {b: (-(-near[b] // CELL_VIDEOS), -(-n // CELL_VIDEOS)) for b, n in there.items() if near[b]}
    if not cuts:
        return rows.sparkSession.createDataFrame([], SCORED)
    ship_package(rows.sparkSession)

    def cut(side: int) -> Column:
        return F.create_map(*(F.lit(x) for b, c in cuts.items() for x in (b, c[side])))[F.col("band")]

    def placed(df: DataFrame, side: int, bands: Column) -> DataFrame:
        df = df.select("ord", "full_hash", "duration", "words", F.lit(side).alias("side"), F.explode(bands).alias("band")).where(F.col("band").isin(*cuts))
        own = F.pmod(F.xxhash64("ord"), cut(side)).cast("int").alias(f"cut{side}")
        return df.select("*", own, F.explode(F.sequence(F.lit(0), cut(1 - side) - 1)).alias(f"cut{1 - side}"))

    cells = placed(queries, 0, F.array(band - 1, band, band + 1)).unionByName(placed(rows, 1, F.array(band)))
    return cells.groupBy("band", "cut0", "cut1").applyInArrow(scored_cell(least, once), SCORED)


def video_matches(queries: DataFrame, rows: DataFrame, threshold: float = VIDEO_THRESHOLD, *, recheck: bool = False, once: bool = False) -> DataFrame:
    """``ord_a, ord_b, delta, similarity`` of query videos (``ord_a``) and alike videos.

    With ``recheck`` pairs that a realignment could still lift over the threshold stay in, marked ``recheck``.
    """
    found = scored_videos(queries, rows, min(RECHECK_FROM, threshold) if recheck else threshold, once=once)
    if not recheck:
        return found
    again = (F.col("similarity") < threshold) & (F.col("delta") > RECHECK_MIN_DELTA) & (F.col("delta") <= RECHECK_MAX_DELTA)
    return found.withColumn("recheck", again).where((F.col("similarity") >= threshold) | F.col("recheck"))


def realigned(pairs: DataFrame, files: DataFrame, refingerprint, threshold: float = VIDEO_THRESHOLD) -> DataFrame:
    """Second pass over pairs marked ``recheck``: the longer video is fingerprinted over the shorter's span from both ends.

    ``refingerprint`` maps batches (path, span, offset) to (path, span, offset, words); each distinct
    request is decoded once. The pair keeps the better of its plain and realigned scores.
    """
    own = files.select("ord", "path", "duration", F.col("fingerprint").alias("words"))
    a, b = sides(own)
    asked = pairs.where("recheck").join(a, "ord_a").join(b, "ord_b")
    longer = F.col("duration_a") > F.col("duration_b")
    asked = asked.select(
        "ord_a", "ord_b", F.when(longer, F.col("path_a")).otherwise(F.col("path_b")).alias("path"),
        F.round(F.least("duration_a", "duration_b"), 3).alias("span"), F.when(longer, F.col("words_b")).otherwise(F.col("words_a")).alias("short"),
        F.explode(F.array(F.lit(0.0), F.round("delta", 3))).alias("offset"),
    )
    frames = asked.select("path", "span", "offset").distinct().mapInPandas(refingerprint, "path string, span double, offset double, words array<long>")
    scores = asked.join(frames, ["path", "span", "offset"]).groupBy("ord_a", "ord_b").agg(F.max(sequence_similarity(F.col("short"), F.col("words"))).alias("other"))
    best = pairs.join(scores, ["ord_a", "ord_b"], "left").withColumn("similarity", F.greatest("similarity", F.coalesce("other", F.lit(0.0)))).drop("other", "recheck")
    return best.where(F.col("similarity") >= threshold)


def in_order(matches: DataFrame) -> DataFrame:
    """Matches (left, right, similarity) as a report lists them: the most alike first, by the score of two decimals."""
    return matches.orderBy(F.desc(F.round("similarity", 2)), "left", "right")
