"""Folders for intermediate and written tables that all executors share."""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_STAGED: list[str] = []


@functools.cache
def _local_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-gridsift-")


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where that is unset, the warehouse, or for a local master a temporary folder.

    A cluster without spark.checkpoint.dir must not have its warehouse in a folder of one machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.startswith("local"):
        root = _local_dir()
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir")
        if root.startswith(("file:", "/")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/gridsift-{uuid.uuid4().hex[:12]}-{name}"


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def staged_path(df: DataFrame, name: str, **options) -> str:
    """Write ``df`` as Parquet to a path in the shared folder, with options of the writer. It goes at the driver's exit."""
    path = shared_path(df.sparkSession, name)
    if not _STAGED:
        atexit.register(_drop_staged)
    _STAGED.append(path)
    df.write.mode("overwrite").options(**options).parquet(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors. It goes at the driver's exit."""
    return df.sparkSession.read.schema(df.schema).parquet(staged_path(df, name))


def _drop_staged() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        for path in _STAGED:
            drop_path(spark, path)
