"""How well thresholds separate labelled scores. Scores have name, expected (boolean), similarity, raw_similarity, eligible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FALSE_POSITIVE, FALSE_NEGATIVE = 5, 1


def outcome_counts(threshold: float) -> list[Column]:
    hit, expected = F.col("similarity") >= threshold, F.col("expected")
    return [
        F.count_if(hit & expected).alias("tp"), F.count_if(hit & ~expected).alias("fp"),
        F.count_if(~hit & ~expected).alias("tn"), F.count_if(~hit & expected).alias("fn"),
    ]


def weighted(fp: Column, fn: Column) -> Column:
    """Weighted errors: a false positive costs five false negatives."""
    return fp * FALSE_POSITIVE + fn * FALSE_NEGATIVE


def evaluate_threshold(scores: DataFrame, threshold: float) -> DataFrame:
    """``threshold, tp, fp, tn, fn, weighted_errors``; the threshold is compared as it is, and shown with two decimals."""
    counts = scores.agg(*outcome_counts(threshold))
    return counts.select(F.lit(round(threshold, 2)).alias("threshold"), "*", weighted(F.col("fp"), F.col("fn")).alias("weighted_errors"))


def recommend_threshold(scores: DataFrame, current: float) -> DataFrame:
    """The threshold of fewest weighted errors among 0, 100, the current one, every score and a hundredth above it.

    Ties go to fewer false positives, then fewer false negatives, then nearness to the current
    threshold, then the higher one. Counts for all candidates come from running sums over distinct
    scores in range-partitioned order, not from every candidate against every score.
    """
    known = scores.where("similarity is not null").select(F.greatest(F.lit(0.0), F.least(F.lit(100.0), "similarity")).alias("clamped"), "similarity", "expected")
    candidates = known.select(F.explode(F.array("clamped", F.least(F.lit(100.0), F.col("clamped") + 0.01))).alias("at"))
    extra = scores.sparkSession.createDataFrame([(0.0,), (100.0,), (float(current),)], "at double")
    marks = candidates.union(extra).distinct().select("at", F.lit(0).alias("pos"), F.lit(0).alias("neg"), F.lit(True).alias("mark"))
    events = known.groupBy(F.col("similarity").alias("at")).agg(F.count_if("expected").alias("pos"), F.count_if(~F.col("expected")).alias("neg"))
    line = marks.unionByName(events.select("at", "pos", "neg", F.lit(False).alias("mark")))
    # a band of one point is summed by one task each, and bands are added up over at most 102 rows
    banded = line.withColumn("band", F.floor(F.greatest(F.lit(-1.0), F.least(F.lit(101.0), "at"))))
    upto = Window.partitionBy("band").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy("band", "at")
    sums = banded.groupBy("band").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    before = Window.orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    totals = sums.select("band", F.coalesce(F.sum("p").over(before), F.lit(0)).alias("p0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    below = banded.withColumns({"pb": F.sum("pos").over(upto) - F.sum("pos").over(same), "nb": F.sum("neg").over(upto) - F.sum("neg").over(same)}).where("mark")
    everything = events.agg(F.coalesce(F.sum("pos"), F.lit(0)), F.coalesce(F.sum("neg"), F.lit(0)))
    positives, negatives = everything.first()
    counted = below.join(totals, "band").select(
        "at", (F.lit(positives) - F.col("p0") - F.col("pb")).alias("tp"), (F.lit(negatives) - F.col("n0") - F.col("nb")).alias("fp"),
        (F.col("n0") + F.col("nb")).alias("tn"), (F.col("p0") + F.col("pb")).alias("fn"),
    )
    shown = F.round("at", 2)
    cost = F.struct(weighted(F.col("fp"), F.col("fn")).alias("w"), F.col("fp").alias("f"), F.col("fn").alias("g"), F.abs(shown - current).alias("d"), (-shown).alias("t"))
    best = counted.agg(F.min_by(F.struct("at", "tp", "fp", "tn", "fn"), cost).alias("best"))
    found = F.when(F.col("best.tp") + F.col("best.fp") + F.col("best.tn") + F.col("best.fn") > 0, F.round("best.at", 2)).otherwise(F.lit(float(current)))
    return best.select(found.alias("threshold"), "best.tp", "best.fp", "best.tn", "best.fn", weighted(F.col("best.fp"), F.col("best.fn")).alias("weighted_errors"))


def summarize(scores: DataFrame, threshold: float) -> DataFrame:
    """One row: how many of each kind, the lowest positive and highest negative score, and the confusion at the threshold."""
    yes, no = F.col("expected"), ~F.col("expected")
    return scores.agg(
        F.count_if(yes).alias("positives"), F.count_if(no).alias("negatives"),
        F.min(F.when(yes, F.col("similarity"))).alias("min_positive"), F.max(F.when(no, F.col("similarity"))).alias("max_negative"),
        F.min(F.when(yes, F.col("raw_similarity"))).alias("min_raw_positive"), F.max(F.when(no, F.col("raw_similarity"))).alias("max_raw_negative"),
        F.count_if(yes & ~F.col("eligible")).alias("ineligible_positives"), F.count_if(no & ~F.col("eligible")).alias("ineligible_negatives"),
        *outcome_counts(threshold),
    )


def evaluated_pairs(pairs: DataFrame, prints: DataFrame, score: Column, eligible: Column, note: str) -> DataFrame:
    """Labelled scores of manifest pairs: each distinct path is fingerprinted once, ineligible pairs score 0 and say why.

    ``pairs`` has name, left, right, expected; ``prints`` path and what ``score`` and ``eligible`` read, as left_* and right_*.
    """
    a = prints.select(*(F.col(c).alias("left" if c == "path" else f"left_{c}") for c in prints.columns))
    b = prints.select(*(F.col(c).alias("right" if c == "path" else f"right_{c}") for c in prints.columns))
    both = pairs.join(a, "left", "left").join(b, "right", "left").withColumns({"raw": F.coalesce(score, F.lit(0.0)), "eligible": F.coalesce(eligible, F.lit(False))})
    return both.select(
        "name", "expected", F.round(F.when(F.col("eligible"), F.col("raw")).otherwise(0.0), 2).alias("similarity"),
        F.round("raw", 2).alias("raw_similarity"), "eligible", F.when(~F.col("eligible"), F.lit(note)).alias("note"),
    )
