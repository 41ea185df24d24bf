"""The journal of file actions: an append-only table of rows, and what can be read off it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Categories whose items may be acted on, and the one that may be kept as a batch.
MUTABLE, KEEPABLE = ("exact", "video", "image", "audio"), "exact"


def latest(journal: DataFrame, key: str = "operation_id", order: tuple[str, ...] = ("logged_at", "finished_at", "status")) -> DataFrame:
    """The last row logged of each operation; repeated rows count once."""
    columns = [c for c in journal.columns if c != key]
    best = journal.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("row"))
    return best.select(key, *(F.col(f"row.{c}").alias(c) for c in columns)).select(*journal.columns)


def recent(operations: DataFrame, limit: int = 500) -> DataFrame:
    """The operations requested last, at least one."""
    return operations.orderBy(F.desc("requested_at"), "operation_id").limit(max(1, limit))


def decisions(operations: DataFrame) -> DataFrame:
    """``group_id, action, status``: what was asked last for each group."""
    known = operations.where("group_id is not null")
    row = F.max_by(F.struct("action", "status"), F.struct("requested_at", "operation_id")).alias("row")
    return known.groupBy("group_id").agg(row).select("group_id", "row.action", "row.status")


def undoable_batches(batches: DataFrame, moves: DataFrame) -> DataFrame:
    """Batches (batch_id, created_at, status) with at least one completed move, newest first, and how many."""
    done = moves.where("status = 'completed'").groupBy("batch_id").agg(F.count("*").alias("moves"))
    open_ = batches.where(F.col("status").isin("completed", "running", "failed"))
    return open_.join(done, "batch_id").orderBy(F.desc("created_at"), "batch_id")


def latest_undoable(batches: DataFrame, moves: DataFrame) -> DataFrame:
    return undoable_batches(batches, moves).limit(1)


#: Columns that a requested operation is logged with, and those that its outcome changes.
REQUESTED = ("operation_id", "action", "source", "destination", "requested_at")


def requested(operations: DataFrame, logged_at: Column) -> DataFrame:
    """Journal rows for operations that are about to be done; written before anything is touched."""
    missing = [c for c in REQUESTED if c not in operations.columns]
    if missing:
        raise ValueError(f"operations lack {', '.join(missing)}")
    rows = operations.drop("status", "finished_at", "logged_at")
    return rows.withColumns({"status": F.lit("requested"), "finished_at": F.lit(None).cast("double"), "logged_at": logged_at})


def outcomes(journal: DataFrame, results: DataFrame, logged_at: Column) -> DataFrame:
    """Journal rows that end operations: what was last logged of each, with the status, time and message of ``results``.

    ``results`` has operation_id, status, finished_at, message; results of operations never requested are dropped.
    """
    told = results.select("operation_id", F.col("status").alias("s"), F.col("finished_at").alias("f"), F.col("message").alias("m")).dropDuplicates(["operation_id"])
    rows = latest(journal).join(told, "operation_id")
    return rows.withColumns({"status": F.col("s"), "finished_at": F.col("f"), "message": F.col("m"), "logged_at": logged_at}).select(*journal.columns)


def appended(rows: DataFrame, path: str) -> None:
    """Add rows to the journal kept in ``path``; earlier rows are never changed."""
    rows.write.mode("append").parquet(path)


def undo_order(moves: DataFrame, batch: str, *order: str) -> DataFrame:
    """Completed moves of each batch with ``undo``, the place at which each is undone: the last one first, from 0."""
    done = sequenced(moves, batch, *order).where("status = 'completed'")
    return done.withColumn("undo", F.row_number().over(Window.partitionBy(batch).orderBy(F.desc("sequence"))) - 1)


def sequenced(moves: DataFrame, batch: str, *order: str) -> DataFrame:
    """``moves`` with ``sequence``, their place in the batch from 0; undoing goes through it backwards."""
    return moves.withColumn("sequence", F.row_number().over(Window.partitionBy(batch).orderBy(*order)) - 1)


def repeated_sources(jobs: DataFrame, batch: str, *order: str) -> DataFrame:
    """``jobs`` with ``skipped``: true for every job of a source after its first in the batch."""
    nth = F.row_number().over(Window.partitionBy(batch, "source").orderBy(*order))
    return jobs.withColumn("skipped", nth > 1)


def keeper_checks(files: DataFrame, group: str) -> DataFrame:
    """Each file of a group against the group's keeper (its smallest ord): ``matches`` where size and hash are the same.

    A missing hash matches nothing.
    """
    keepers = files.groupBy(group).agg(F.min_by(F.struct("ord", "size", "full_hash"), "ord").alias("keeper"))
    same = (F.col("size") == F.col("keeper.size")) & (F.col("full_hash") == F.col("keeper.full_hash"))
    checked = files.join(keepers, group).where(F.col("ord") != F.col("keeper.ord"))
    return checked.select(group, F.col("keeper.ord").alias("keeper_ord"), "ord", F.coalesce(same, F.lit(False)).alias("matches"))


def eligible_for(items: DataFrame, action: str) -> DataFrame:
    """Review items an action may be asked for."""
    return items.where(F.col("category") == KEEPABLE) if action == "keep" else items.where(F.col("category").isin(*MUTABLE))


def free_paths(plan: DataFrame, destination: str, existing: DataFrame, *order: str) -> DataFrame:
    """``plan`` with ``nth``: how many earlier rows or existing paths (path) have the same destination."""
    nth = F.row_number().over(Window.partitionBy(destination).orderBy(*order)) - 1
    there = existing.select(F.col("path").alias(destination), F.lit(1).alias("there")).distinct()
    return plan.withColumn("nth", nth).join(there, destination, "left").withColumn("nth", F.col("nth") + F.coalesce("there", F.lit(0))).drop("there")


def outcome_rates(operations: DataFrame) -> DataFrame:
    """Operations per action and status, with the seconds they took."""
    seconds: Column = F.sum(F.coalesce(F.col("finished_at") - F.col("requested_at"), F.lit(0.0)))
    return operations.groupBy("action", "status").agg(F.count("*").alias("operations"), F.count("finished_at").alias("finished"), F.count_if(F.col("reversible") != 0).alias("reversible"), seconds.alias("seconds"))
