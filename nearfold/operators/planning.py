"""Plans that bring a title's scattered folders together: where each file would go, and what stands in the way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import file_name, parent, suggested_destination

READY, IN_PLACE, CONFLICT = "ready", "already in place", "conflict"


def source_folders(files: DataFrame) -> DataFrame:
    """``folder, files, depth``: every folder that holds files itself, by depth and name."""
    folders = files.groupBy(parent(F.col("path")).alias("folder")).agg(F.count("*").alias("files"))
    depth = F.size(F.split(F.trim(F.col("folder"), F.lit("/")), "/"))
    return folders.withColumn("depth", depth).orderBy("depth", F.lower("folder"), "folder")


def suggested_mappings(folders: DataFrame, titles: DataFrame) -> DataFrame:
    """``folder, title_root, destination``: where each source folder below a title would go.

    ``folders`` has folder and title_root, ``titles`` title_root and final_name. A title with one
    source folder takes its files directly.
    """
    relative = F.substr(F.col("folder"), F.length("title_root") + 2)
    mapped = folders.join(titles, "title_root").withColumn("destination", suggested_destination(relative, F.col("final_name")))
    counts = folders.groupBy("title_root").agg(F.count("*").alias("sources"))
    return mapped.join(counts, "title_root").select("folder", "title_root", F.when(F.col("sources") == 1, F.lit(".")).otherwise(F.col("destination")).alias("destination"))


def move_plan(files: DataFrame, mappings: DataFrame, existing: DataFrame) -> DataFrame:
    """``source, destination, size, mtime, status`` for every file directly in a mapped folder.

    ``files`` has path, size, mtime; ``mappings`` folder, final_root, destination ('.' for the root);
    ``existing`` path. A destination that exists, or that several files would take, is a conflict.
    """
    placed = files.withColumn("folder", parent(F.col("path"))).join(mappings, "folder")
    below = F.when(F.col("destination") == ".", F.lit("")).otherwise(F.concat(F.col("destination"), F.lit("/")))
    target = F.concat(F.col("final_root"), F.lit("/"), below, file_name(F.col("path")))
    plan = placed.select(F.col("path").alias("source"), target.alias("destination"), "size", "mtime")
    taken = existing.select(F.col("path").alias("destination"), F.lit(True).alias("there")).distinct()
    wanted = plan.groupBy("destination").agg(F.count("*").alias("wanted"))
    status = F.when(F.col("source") == F.col("destination"), IN_PLACE).when(F.col("there") | (F.col("wanted") > 1), CONFLICT).otherwise(READY)
    return plan.join(taken, "destination", "left").join(wanted, "destination").select("source", "destination", "size", "mtime", status.alias("status"))


def ready_moves(plan: DataFrame) -> DataFrame:
    return plan.where(F.col("status") == READY)


def conflicts(plan: DataFrame) -> DataFrame:
    return plan.where(F.col("status") == CONFLICT)


def selected_moves(plan: DataFrame, chosen: DataFrame) -> DataFrame:
    """A plan with only the chosen (source, destination) of its ready moves; other rows stay."""
    ready = ready_moves(plan).join(chosen, ["source", "destination"], "left_semi")
    return plan.where(F.col("status") != READY).unionByName(ready.select(*plan.columns))


def deepest_first(folders: DataFrame) -> DataFrame:
    """Folders in the order in which emptied ones can be removed."""
    return folders.withColumn("depth", F.size(F.split(F.trim(F.col("folder"), F.lit("/")), "/"))).orderBy(F.desc("depth"), F.desc("folder"))
