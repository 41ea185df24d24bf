"""A store of fingerprints and names between runs: reuse what is still valid, replace what is new, count what is there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINGERPRINT_VERSION = 2
MTIME_TOLERANCE = 1e-6
#: What each kind of reset forgets; video and audio share the duration.
RESETS = {
    "hashes": ["partial_hash", "partial_hash_algo", "full_hash", "full_hash_algo"],
    "video": ["duration", "fingerprint", "fingerprint_version"],
    "images": ["image_fingerprint"],
    "audio": ["duration", "audio_fingerprint"],
}
_KEPT = ["full_hash", "duration", "fingerprint", "fingerprint_version", "image_fingerprint", "audio_fingerprint"]


def still_valid(prefix: str = "stored_") -> Column:
    """Whether a stored row describes the scanned file: same size, and mtime within a microsecond."""
    return F.coalesce((F.col("size") == F.col(f"{prefix}size")) & (F.abs(F.col("mtime") - F.col(f"{prefix}mtime")) <= MTIME_TOLERANCE), F.lit(False))


def hydrated(scanned: DataFrame, store: DataFrame) -> DataFrame:
    """``scanned`` (path, size, mtime, raw_name, ...) with what the store still knows, and ``reused``.

    A valid row gives back its name and results; video fingerprints of another version count as missing.
    """
    kept = [c for c in _KEPT if c in store.columns]
    stored = store.select("path", *(F.col(c).alias(f"stored_{c}") for c in ["size", "mtime", "raw_name", *kept]))
    joined = scanned.drop(*kept).join(stored, "path", "left").withColumn("reused", still_valid())
    current = F.col("reused") & (F.col("stored_fingerprint_version") == FINGERPRINT_VERSION) if "fingerprint_version" in kept else F.col("reused")
    columns = {c: F.when(current if c.startswith("fingerprint") else F.col("reused"), F.col(f"stored_{c}")) for c in kept}
    columns["raw_name"] = F.when(F.col("reused"), F.col("stored_raw_name")).otherwise(F.col("raw_name"))
    return joined.withColumns(columns).drop(*(c for c in stored.columns if c != "path"))


def upserted(store: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """``store`` with ``rows`` in place of those of equal keys; columns that one side lacks are null there."""
    return store.join(rows.select(*keys), list(keys), "left_anti").unionByName(rows, allowMissingColumns=True)


def cleared(store: DataFrame, paths: DataFrame, kind: str) -> DataFrame:
    """``store`` with the results of ``kind`` forgotten for ``paths``."""
    hit = store.join(paths.select("path").distinct().withColumn("hit", F.lit(True)), "path", "left")
    gone = {c: F.when(F.col("hit").isNull(), F.col(c)) for c in RESETS[kind] if c in store.columns}
    return hit.withColumns(gone).select(*store.columns)


def migrated(store: DataFrame, schema) -> DataFrame:
    """``store`` with every column of ``schema`` it lacks added as null; its own columns stay."""
    missing = {f.name: F.lit(None).cast(f.dataType) for f in schema.fields if f.name not in store.columns}
    return store.withColumns(missing) if missing else store


def statistics(store: DataFrame) -> DataFrame:
    """One row of counts: files, and those with each kind of result."""
    have = {
        "hashed": "full_hash", "with_duration": "duration", "video_fingerprints": "fingerprint",
        "image_fingerprints": "image_fingerprint", "audio_fingerprints": "audio_fingerprint",
    }
    current = F.count_if(F.col("fingerprint").isNotNull() & F.coalesce(F.col("fingerprint_version") == FINGERPRINT_VERSION, F.lit(False)))
    return store.agg(F.count("*").alias("files"), *(F.count(c).alias(n) for n, c in have.items()), current.alias("current_video_fingerprints"))


def counts_by(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows per combination of columns, those with a null first column left out, largest first."""
    return rows.where(F.col(columns[0]).isNotNull()).groupBy(*columns).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *columns)
