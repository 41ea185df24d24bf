"""What every operator needs from the session: a shared folder, staged tables, code on the executors.

Lineage is cut by writing a Parquet table below ``spark.checkpoint.dir`` and reading it back. Unlike
a cached or locally checkpointed block such a table outlives a lost executor, is compressed, keeps
only the columns asked for and gives Spark exact sizes for the plans that follow.
"""

from __future__ import annotations

import atexit
import math
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_SHIPPED: set[str] = set()
#: Spark's switch for deleting a query's shuffle files when it ends.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's checkpoint folder, else (tests) one of our own."""
    context = spark.sparkContext
    given = context._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get()
    folder = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not local(context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="nearfold-")
        atexit.register(shutil.rmtree, own, True)
        folder = f"file://{own}"
    context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def local(master: str) -> bool:
    """Whether driver and executors are one process."""
    return master == "local" or master.startswith("local[")


def staged_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; ``staged_at`` gives the path.

    What the write shuffled is deleted with its end, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = path or staged_path(spark, label)
    before = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(TIDY) if before is None else spark.conf.set(TIDY, before)
    back = spark.read.schema(df.schema).parquet(path)
    back._staged_at = path
    return back


def unstage(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    path = getattr(df, "_staged_at", None)
    if path:
        jvm, spark = df.sparkSession._jvm, df.sparkSession
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def parts_for(rows: int, per_task: int, least: int = 1) -> int:
    """Partitions so that none holds more than ``per_task`` of ``rows`` on average."""
    return max(least, math.ceil(rows / per_task))


def slots(spark: SparkSession) -> int:
    """Tasks that a small exchange should be cut into: the session's shuffle width, 1 at least."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def ship_package(spark: SparkSession) -> None:
    """Put this package on the executors' path once per session; local masters share the driver's."""
    context = spark.sparkContext
    if local(context.master) or context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as folder:
        archive = os.path.join(folder, "nearfold_code.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted(root.rglob("*.py")):
                out.write(source, Path("nearfold") / source.relative_to(root))
        target = f"{shared_dir(spark)}/code-{uuid.uuid4().hex[:8]}/nearfold_code.zip"
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).copyFromLocalFile(
            spark._jvm.org.apache.hadoop.fs.Path(archive), path
        )
        context.addPyFile(target)
    _SHIPPED.add(context.applicationId)
