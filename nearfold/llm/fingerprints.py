"""All pairs of files whose media fingerprints are alike enough, by combinations of bit tokens.

Rows with one and the same fingerprint form a class; classes are joined, not rows. Within a class
and between alike classes rows are told apart by their full hash first (rows of one non-null hash
never pair up), so a large group of byte-identical copies costs no pairs.

Defined results: null and empty fingerprints, and those that hold a null word, have no similarity;
null, NaN and non-positive durations never agree; repeated rows are rows of their own; scores are
compared unrounded. Every alike pair is found for certain, whatever the size of the table and
however frequent its words are (see ``alikeness``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import durations_compatible, flat
from ..runtime import stage, unstage
from .alikeness import AUDIO, IMAGE, VIDEO, Kind
from ..operators.combinations import combination_pairs, frequent_words
from .expansion import member_pairs
from .hotpairs import combined_pairs, touched_items

KINDS = {"video": VIDEO, "image": IMAGE, "audio": AUDIO}
AUDIO_SECONDS = 3.0


def usable(column: str) -> Column:
    """A fingerprint with words, none of them null."""
    words = F.col(column)
    return words.isNotNull() & (F.size(words) > 0) & ~F.exists(words, lambda w: w.isNull())


def classes_of(rows: DataFrame, words: str) -> DataFrame:
    """``id, words, mixed``: one row per distinct fingerprint; ``id`` is its smallest ord.

    ``mixed`` tells that some of its rows may pair up: they have several hashes, or none.

    Two 64-bit hashes of different seeds stand for the fingerprint while rows are gathered.
    """
    return rows.groupBy("h1", "h2").agg(
        F.min("ord").alias("id"),
        F.first(words).alias("words"),
        ((F.count("*") > 1) & ((F.count("*") > F.count("full_hash")) | (F.min("full_hash") < F.max("full_hash")))).alias("mixed"),
    )


def with_class_key(rows: DataFrame, words: str) -> DataFrame:
    return rows.withColumns({"h1": F.xxhash64(words), "h2": F.xxhash64(F.lit(1), F.reverse(words))})


def verified(kind: Kind):
    """Keeps the pairs ``a, b`` whose words (columns 2 and 3) are alike."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = kind.alike(*flat(batch.column(2)), *flat(batch.column(3)), kind.least)
            yield batch.select([0, 1]).filter(pa.array(good))

    return check


def _scored_pairs(pairs: DataFrame, classes: DataFrame, kind: Kind) -> DataFrame:
    words = classes.select(F.col("id"), F.col("words"))
    both = pairs.join(words.toDF("a", "words_a"), "a").join(words.toDF("b", "words_b"), "b")
    return both.select("a", "b", "words_a", "words_b").mapInArrow(verified(kind), "a long, b long")


def alike_classes(classes: DataFrame, kind: Kind) -> DataFrame:
    """``a, b`` (``a < b``), distinct: all alike pairs of ``classes`` (id, words; a staged table)."""
    indexed = F.slice("words", 1, 1) if kind is IMAGE else F.col("words")
    items = classes.select("id", "words", indexed.alias("indexed"))
    lengths = _lengths(items)
    hot = frequent_words(items.select(F.col("indexed").alias("words")), sum(n * c for n, c in lengths.items()))
    looked_up = items.select("id", F.col("indexed").alias("words"))
    pairs = combination_pairs(looked_up, kind.indexes(lengths, hot, False))
    if not len(hot):
        return _scored_pairs(pairs, classes, kind)
    touched = stage(touched_items(items, hot, kind.reach, kind.bits), f"{kind.name}-touched")
    lengths = _lengths(touched)
    if any(kind.lost(n) for n in lengths):
        pairs = pairs.union(combination_pairs(touched.select("id", F.col("indexed").alias("words")), kind.indexes(lengths, hot, True))).distinct()
    more = combined_pairs(touched, lost=kind.lost, alike=kind.alike, least=kind.least, likely=kind.likely)
    return _scored_pairs(pairs, classes, kind).union(more).distinct()


def _lengths(items: DataFrame) -> dict[int, int]:
    return {r.n: r.c for r in items.groupBy(F.size("indexed").alias("n")).agg(F.count("*").alias("c")).collect()}


def _rows_of(files: DataFrame, medium: str) -> DataFrame:
    words = {"video": "fingerprint", "image": "image_fingerprint", "audio": "audio_fingerprint"}[medium]
    rows = files.where(F.col("ord").isNotNull() & usable(words))
    if medium == "video":
        rows = rows.where("fingerprint_version = 2 and duration > 0 and not isnan(duration)")
    elif medium == "audio":
        rows = rows.where("duration is not null and not isnan(duration)")
    else:
        rows = rows.where(F.size(words) == 4)
    duration = F.col("duration") if medium != "image" else F.lit(None).cast("double")
    return rows.select("ord", "full_hash", duration.alias("duration"), F.col(words).alias("words"))


def alike_pairs(files: DataFrame, medium: str) -> DataFrame:
    """``ord_a, ord_b`` of the rows of ``files`` alike in ``medium`` ('video', 'image' or 'audio')."""
    rows = with_class_key(_rows_of(files, medium), "words")
    classes = stage(classes_of(rows, "words"), f"{medium}-classes")
    pairs = alike_classes(classes, KINDS[medium])
    inner = classes.where("mixed").select(F.col("id").alias("a"), F.col("id").alias("b"))
    pairs = stage(pairs.union(inner), f"{medium}-pairs")
    used = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    keys = classes.join(used, "id", "left_semi").select("h1", "h2", "id")
    own = F.coalesce(F.concat(F.lit("h"), "full_hash"), F.concat(F.lit("o"), F.col("ord").cast("string")))
    members = stage(rows.select("ord", "full_hash", "duration", "h1", "h2").join(keys, ["h1", "h2"]).select("id", "ord", "duration", own.alias("own")), f"{medium}-members")
    # rows of one class and one hash, still one unit
    units = members.groupBy("id", "own").agg(F.min("ord").alias("unit"))
    a, b = units.toDF("a", "own_a", "unit_a"), units.toDF("b", "own_b", "unit_b")
    between = pairs.join(a, "a").join(b, "b").where("own_a <> own_b and (a <> b or unit_a < unit_b)")
    between = between.select(F.col("unit_a").alias("a"), F.col("unit_b").alias("b"))
    units = members.join(units.select("id", "own", "unit"), ["id", "own"]).select(F.col("unit").alias("g"), "ord", "duration")
    found = member_pairs(between, units)
    left, right = F.col("duration_a"), F.col("duration_b")
    if medium == "video":
        found = found.where(durations_compatible(left, right))
    elif medium == "audio":
        found = found.where(F.abs(left - right) <= AUDIO_SECONDS)
    return found.select(F.least("ord_a", "ord_b").alias("ord_a"), F.greatest("ord_a", "ord_b").alias("ord_b"))
