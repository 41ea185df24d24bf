"""Files that keep arriving: each micro-batch against the store, which then takes it in.

An extension: a stream of file rows is handled by foreachBatch, so that every batch sees the store
as the one before left it, and a batch that is run again after a failure changes nothing more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import upserted
from ..runtime import stage
from ..sources.manifest import read_store, replace_store


def known_copies(batch: DataFrame, store: DataFrame | None) -> DataFrame:
    """``ord, path, known_path``: rows of a batch whose full hash the store or an earlier row of the batch has."""
    hashed = batch.where("full_hash is not null")
    first = hashed.groupBy("full_hash").agg(F.min_by("path", "ord").alias("first"), F.min("ord").alias("first_ord"))
    rows = hashed.join(first, "full_hash")
    if store is None:
        return rows.where("ord <> first_ord").select("ord", "path", F.col("first").alias("known_path"))
    there = store.where("full_hash is not null").groupBy("full_hash").agg(F.min("path").alias("stored"))
    # a path that the store already has is the same file seen again, not a copy
    rows = rows.join(there, "full_hash", "left").where("(stored is not null and stored <> path) or (stored is null and ord <> first_ord)")
    return rows.select("ord", "path", F.coalesce("stored", "first").alias("known_path"))


def arrival_handler(store_path: str, found_path: str) -> Callable[[DataFrame, int], None]:
    """What to do with a micro-batch: write its known copies under the batch's number, then upsert it into the store."""

    def handle(batch: DataFrame, number: int) -> None:
        rows = stage(batch, "arrivals")
        store = read_store(rows.sparkSession, store_path)
        copies = known_copies(rows, store)
        copies.write.mode("overwrite").parquet(f"{found_path}/batch={number}")
        replace_store(rows.dropDuplicates(["path"]) if store is None else upserted(store, rows.dropDuplicates(["path"]), "path"), store_path)

    return handle


def watch_arrivals(stream: DataFrame, store_path: str, found_path: str, checkpoint: str) -> StreamingQuery:
    """Start a query that takes in everything available and stops."""
    return (
        stream.writeStream.foreachBatch(arrival_handler(store_path, found_path))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
