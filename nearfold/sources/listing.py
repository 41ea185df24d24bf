"""Files of folder trees as rows, and which root owns a file that several claim."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.media import VIDEO, normalize_extensions
from ..functions.paths import inside

LISTING = "path string, root string, root_order int, size long, mtime double, raw_name string, error string"


def owned_by_first_root(files: DataFrame, roots: DataFrame) -> DataFrame:
    """``files`` (path) with the first root (root, position) that contains each; files below no root are dropped.

    A path is looked up by each of its own ancestors, so the roots are joined by equality.
    """
    parts = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    claims = files.withColumn("root", F.explode(ancestors)).join(roots.select(F.rtrim("root", F.lit("/")).alias("root"), "position"), "root")
    first = claims.groupBy(*files.columns).agg(F.min_by("root", F.struct("position", "root")).alias("root"))
    return first


def contained(files: DataFrame, root: str) -> DataFrame:
    return files.where(inside(F.col("path"), F.lit(root)))


def walk(root: str, extensions: set[str], order: int, follow: bool = False) -> Iterator[tuple]:
    """Rows of the files below one root, hidden and empty ones too; a file that cannot be read comes with its error."""
    seen: set[str] = set()
    top = os.path.realpath(os.path.expanduser(root))
    if not os.path.isdir(top):
        yield None, top, order, None, None, None, "not a folder"
        return
    for folder, folders, names in os.walk(top, followlinks=follow):
        real = os.path.realpath(folder)
        if real in seen:
            folders[:] = []
            continue
        seen.add(real)
        folders.sort()
        for name in sorted(names):
            if Path(name).suffix.lower() not in extensions:
                continue
            path = os.path.realpath(os.path.join(folder, name))
            try:
                stat = os.stat(path)
            except OSError as error:
                yield path, top, order, None, None, Path(name).stem, str(error)
                continue
            yield path, top, order, stat.st_size, stat.st_mtime, Path(name).stem, None


class _Root(InputPartition):
    def __init__(self, root: str, order: int):
        self.root, self.order = root, order


class _Reader(DataSourceReader):
    def __init__(self, roots: list[str], extensions: set[str], follow: bool):
        self.roots, self.extensions, self.follow = roots, extensions, follow

    def partitions(self) -> list[_Root]:
        return [_Root(root, i) for i, root in enumerate(self.roots)]

    def read(self, partition: _Root) -> Iterator[tuple]:
        yield from walk(partition.root, self.extensions, partition.order, self.follow)


class FolderSource(DataSource):
    """``spark.read.format("folders").option("roots", "a|b").load()``: one task lists each root."""

    @classmethod
    def name(cls) -> str:
        return "folders"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> _Reader:
        roots = [r for r in self.options.get("roots", self.options.get("path", "")).split("|") if r]
        extensions = normalize_extensions([e for e in self.options.get("extensions", "").split(",") if e])
        return _Reader(roots, extensions, self.options.get("follow", "false") == "true")


def scan(spark: SparkSession, roots: Iterable[str], extensions: Iterable[str] | None = None) -> DataFrame:
    """``ord, path, root, size, mtime, raw_name, error`` of all files below the roots; a path belongs to the first root that reaches it.

    ``ord`` follows root order and path; its numbers have gaps.
    """
    spark.dataSource.register(FolderSource)
    wanted = ",".join(sorted(normalize_extensions(extensions)))
    rows = spark.read.format("folders").option("roots", "|".join(roots)).option("extensions", wanted).load()
    nth = F.row_number().over(Window.partitionBy("path").orderBy("root_order"))
    owned = rows.withColumn("nth", nth).where("nth = 1 or path is null").drop("nth")
    return owned.orderBy("root_order", "path").withColumn("ord", F.monotonically_increasing_id()).select("ord", "path", "root", "size", "mtime", "raw_name", "error")


def videos_below(spark: SparkSession, root: str) -> DataFrame:
    """Video files below one folder, linked folders followed once, each real file once, in order of name."""
    spark.dataSource.register(FolderSource)
    rows = spark.read.format("folders").option("roots", root).option("extensions", ",".join(VIDEO)).option("follow", "true").load()
    return rows.where("path is not null").dropDuplicates(["path"]).orderBy(F.lower("path"))
