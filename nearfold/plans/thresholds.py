"""A threshold benchmark: labelled pairs of a manifest, fingerprints once per file, and per medium how well its threshold does."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.similarity import audio_similarity, durations_compatible, image_similarity, sequence_similarity
from ..operators.evaluation import evaluated_pairs, recommend_threshold, summarize
from ..operators.matching import AUDIO_SECONDS, AUDIO_THRESHOLD, IMAGE_THRESHOLD, VIDEO_THRESHOLD
from ..runtime import stage
from ..sources.media import Decoder, fingerprints

THRESHOLDS = {"video": VIDEO_THRESHOLD, "image": IMAGE_THRESHOLD, "audio": AUDIO_THRESHOLD}
_WORDS = {"video": "fingerprint", "image": "image_fingerprint", "audio": "audio_fingerprint"}


def manifest_prints(pairs: DataFrame, decoder: Decoder) -> DataFrame:
    """Fingerprints of every distinct file of a manifest."""
    paths = pairs.select(F.col("left").alias("path")).union(pairs.select("right")).distinct()
    return stage(fingerprints(paths, decoder), "manifest-prints")


def medium_scores(pairs: DataFrame, prints: DataFrame, medium: str) -> DataFrame:
    """Labelled scores of one medium's pairs; those whose durations rule them out score 0 and say so."""
    left, right = (F.col(f"{side}_{_WORDS[medium]}") for side in ("left", "right"))
    a, b = F.col("left_duration"), F.col("right_duration")
    score = {"video": sequence_similarity, "image": image_similarity, "audio": audio_similarity}[medium](left, right)
    fits = {"video": durations_compatible(a, b), "image": F.lit(True), "audio": F.abs(a - b) <= AUDIO_SECONDS}[medium]
    own = pairs.where(F.col("media_type") == medium).select("name", "left", "right", "expected")
    return evaluated_pairs(own, prints.select("path", "duration", _WORDS[medium]), score, fits, "durations too far apart")


def threshold_report(spark: SparkSession, scores: dict[str, DataFrame], current: dict[str, float] | None = None) -> DataFrame:
    """One row per medium: the summary at its threshold, and the threshold that would cost least."""
    current, out = {**THRESHOLDS, **(current or {})}, None
    for medium, rows in scores.items():
        best = recommend_threshold(rows, current[medium]).first()
        row = summarize(rows, current[medium]).select(
            F.lit(medium).alias("medium"), F.lit(current[medium]).alias("threshold"), "*",
            F.lit(best.threshold).alias("recommended"), F.lit(best.weighted_errors).cast("long").alias("recommended_errors"),
        )
        out = row if out is None else out.union(row)
    return out
