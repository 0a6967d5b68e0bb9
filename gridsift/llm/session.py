"""Session helpers shared by the llm operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import itertools
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import shared_root

_NUMBER = itertools.count()
_OWN = uuid.uuid4().hex[:12]
_ROOTS: set[str] = set()


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path for an intermediate table in the shared folder."""
    root = f"{shared_root(spark)}/gridsift-{_OWN}"
    if root not in _ROOTS:
        _ROOTS.add(root)
        atexit.register(_drop_root, root)
    return f"{root}/{next(_NUMBER)}-{name}"


def _drop_root(root: str) -> None:
    """At the driver's exit, its intermediate tables go, if its session still runs."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        drop_stage(spark, root)


def staged(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark, schema = df.sparkSession, df.schema
    path = path or stage_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # so that Spark's cleaner drops the shuffle files behind what is now written
    return spark.read.schema(schema).parquet(path)


def drop_stage(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Intermediate tables that go when the block ends, by when all that reads them must be written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for p in self.paths:
            drop_stage(self.spark, p)

    def staged(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(stage_path(self.spark, name))
        return staged(df, name, self.paths[-1])


def trimmed(run: Callable, cycles: bool = True) -> Callable:
    """``run``, a function of Arrow batches, that gives freed memory back at its task's end: idle Python workers stay, and share an executor's memory.

    Looking for garbage in ``cycles`` costs some 80 ms, too much for many short tasks.
    """

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        if cycles:
            gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # glibc only
            ctypes.CDLL(None).malloc_trim(0)

    return whole


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Arrow batches of at most ``rows`` rows: texts are long, and Python workers share an executor's memory.

    Queries return tables that run later, so this stays set for the session.
    """
    spark.conf.set(_BATCH, str(rows))


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for what runs inside; then as before."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
