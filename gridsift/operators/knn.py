"""Exact nearest-neighbour joins, and the scores built on them.

Queries meet the bank as bounded blocks of rows in numpy. A bank of at most ``BANK_BYTES`` is broadcast; a larger one is indexed
by pivots (pivots.py), and queries meet only the blocks that the triangle inequality leaves. No pair is ever a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import blocks
from ..sources.shared import staged_path
from . import pivots
from .coresets import coreset

#: Most bytes of a bank's vectors as doubles that each Python worker holds.
BANK_BYTES = 64 << 20
#: Of a larger bank that tasks read part by part, bytes of a part's vectors as doubles.
PART_BYTES = 16 << 20


def _matrix(column: pa.Array) -> np.ndarray:
    return blocks.unit_rows(blocks.matrix(column))


def _shared(bank: DataFrame):
    """A broadcast pair of ``bank`` (bank_id, v): ascending ids, and unit rows."""
    got = bank.toArrow()
    got = got.take(pa.array(np.argsort(got.column(0).to_numpy(), kind="stable")))
    return bank.sparkSession.sparkContext.broadcast((got.column(0).to_numpy(), _matrix(got.column(1))))


def knn_join(query: DataFrame, bank: DataFrame, k: int, query_id: str = "query_id", bank_id: str = "bank_id", column: str = "embedding", bank_bytes: int | None = None) -> DataFrame:
    """query_id, rank, bank_id, similarity (cosine) of the k nearest bank rows of each query, ties by bank_id.

    Ids are longs; query ids are distinct. Similarities are compared to 12 decimals. With a bank of fewer rows, each query
    has so many; an empty bank gives no rows. Null vectors are left out.
    """
    query = query.select(F.col(query_id).cast("long").alias("query_id"), F.col(column).cast("array<double>").alias("v")).where("v IS NOT NULL")
    bank = bank.select(F.col(bank_id).cast("long").alias("bank_id"), F.col(column).cast("array<double>").alias("v")).where("v IS NOT NULL")
    size = bank.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).head()
    out = "query_id long, rank int, bank_id long, similarity double"
    if not size.n:
        return query.sparkSession.createDataFrame([], out)

    def nearest(ids: np.ndarray, x: np.ndarray, bank_ids: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        found, value = blocks.nearest_rows(x, y, bank_ids, k)
        width = found.shape[1]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, width)), pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), len(ids))), pa.array(found.ravel()), pa.array(value.ravel())], ["query_id", "rank", "bank_id", "similarity"])

    if size.n * size.d * 8 <= (BANK_BYTES if bank_bytes is None else bank_bytes):
        shared = _shared(bank)

        def run(batches: Iterator[pa.RecordBatch]):
            for batch in batches:
                for i in range(0, batch.num_rows, 512):
                    part = batch.slice(i, 512)
                    yield nearest(part.column(0).to_numpy(), _matrix(part.column(1)), *shared.value)

        return query.mapInArrow(run, out)

    return pivots.nearest(query, pivots.build(bank, size.n, size.d), k, size.d)


def bank_parts(bank: DataFrame, bank_id: str = "bank_id", column: str = "embedding", bank_bytes: int | None = None) -> tuple[int, Callable[[], Iterator[np.ndarray]]]:
    """The number of a bank's rows, and a function by which a task gets their unit rows, a bounded part at a time.

    A bank of at most ``BANK_BYTES`` is broadcast. A larger one is written to the shared folder and read there part by part
    by each task that asks, so neither the driver nor a worker ever holds it; Arrow must know that folder's file system.
    """
    bank = bank.select(F.col(bank_id).cast("long").alias("bank_id"), F.col(column).cast("array<double>").alias("v")).where("v IS NOT NULL")
    size = bank.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).head()
    if size.n * (size.d or 1) * 8 <= (BANK_BYTES if bank_bytes is None else bank_bytes):
        shared = _shared(bank)
        return size.n, lambda: iter([shared.value[1]])
    path, rows = staged_path(bank.select("v"), "bank", **{"parquet.block.size": str(PART_BYTES)}), max(1, PART_BYTES // (8 * size.d))

    def parts() -> Iterator[np.ndarray]:
        fs, root = pafs.FileSystem.from_uri(path)
        for f in fs.get_file_info(pafs.FileSelector(root)):
            if f.base_name.endswith(".parquet"):
                with fs.open_input_file(f.path) as source:
                    for batch in pq.ParquetFile(source).iter_batches(rows, use_threads=False):
                        yield _matrix(batch.column(0))

    return size.n, parts


def mutual_nn(a: DataFrame, b: DataFrame, a_id: str = "a_id", b_id: str = "b_id") -> DataFrame:
    """a_id, b_id, similarity of the pairs that are each other's nearest."""
    there = knn_join(a, b, 1, a_id, b_id).select(F.col("query_id").alias("a_id"), F.col("bank_id").alias("b_id"), "similarity")
    back = knn_join(b, a, 1, b_id, a_id).select(F.col("query_id").alias("b_id"), F.col("bank_id").alias("a_id"))
    return there.join(back, ["a_id", "b_id"])


def anomaly_scores(query: DataFrame, bank: DataFrame, k: int, query_id: str = "query_id", bank_id: str = "bank_id") -> DataFrame:
    """query_id and score: the mean of the k least cosine distances, each within 0 and 2. A bank of fewer rows is an error."""
    if bank.limit(k).count() < k:
        raise ValueError("k is more than the bank's rows")
    rows = knn_join(query, bank, k, query_id, bank_id)
    distance = F.least(F.greatest(1 - F.col("similarity"), F.lit(0.0)), F.lit(2.0))
    return rows.groupBy("query_id").agg(F.avg(distance).alias("score"))


def score_bank(query: DataFrame, bank: DataFrame, k: int, query_id: str = "query_id", bank_id: str = "bank_id") -> DataFrame:
    """query_id and score: the mean of the min(k, rows) greatest similarities."""
    return knn_join(query, bank, k, query_id, bank_id).groupBy("query_id").agg(F.avg("similarity").alias("score"))


def score_bank_bg(query: DataFrame, bank: DataFrame, k: int, query_id: str = "query_id", bank_id: str = "bank_id", side: str = "is_fg") -> DataFrame:
    """query_id and score: of the k nearest rows of a bank with both sides, the mean similarity of foreground ones (0 without any)."""
    rows = knn_join(query, bank, k, query_id, bank_id).join(bank.select(F.col(bank_id).cast("long").alias("bank_id"), side), "bank_id")
    fg = F.col(side)
    return rows.groupBy("query_id").agg((F.coalesce(F.sum(F.when(fg, F.col("similarity"))), F.lit(0.0)) / F.greatest(F.lit(1), F.count(F.when(fg, 1)))).alias("score"))


def score_fgbg_knn(query: DataFrame, fg: DataFrame, bg: DataFrame, k: int, query_id: str = "query_id", bank_id: str = "bank_id") -> DataFrame:
    """query_id and score: mean of the k nearest foreground similarities less that of the background."""
    a = score_bank(query, fg, k, query_id, bank_id).withColumnRenamed("score", "fg")
    b = score_bank(query, bg, k, query_id, bank_id).withColumnRenamed("score", "bg")
    return a.join(b, "query_id").select("query_id", (F.col("fg") - F.col("bg")).alias("score"))


def memory_bank(patches: DataFrame, n: int | None = None, bank_id: str = "bank_id", ratio: float | None = None, smoothing: bool = False, **filters) -> DataFrame:
    """Filtered, normalised patches as a bank, thinned to ``n`` rows or to a ``ratio`` of them (one at least); an empty one is an error.

    With ``smoothing``, vectors are means over 3 x 3 boxes of their image's whole grid, before the filters.
    """
    from ..functions.vectors import unit
    from .retrieval import filter_patches
    from .scoremaps import box_smooth_vectors

    rows = filter_patches(patches, **filters)
    if smoothing:
        rows = rows.drop("embedding").join(box_smooth_vectors(patches, ["image_id"]), ["image_id", "row", "col"])
    rows = unit(rows, "embedding")
    if not rows.head(1):
        raise ValueError("the memory bank is empty")
    if ratio is not None:
        n = max(1, int(rows.count() * ratio))
    return rows if n is None else coreset(rows, n, bank_id)
