"""Composable core-sets: rows that cover a bank of vectors, by greedy k-centre on bounded batches.

Rows are dealt into batches by a hash of their id, so what is chosen does not depend on the partitioning. Each batch is
cut to its greedy centres, which carry the rows that they stand for and the angle within which these lie. The centres of
several batches make the next batch, up a tree of which each level is written. The number of passes is the logarithm of
the bank's size over a batch's and does not depend on how many rows are chosen.

Each greedy step covers what it gets within twice the best angle that so many centres can reach, so a tree of L levels
covers the bank within 2 L times that angle; one batch is the plain greedy choice.

A core-set too large for one batch is made in Voronoi cells around pivots that are a small core-set themselves. Each cell
is cut by its own tree, and of all cells' centres those chosen at the largest distances stay, so cells are covered to the
same radius, whatever their share of the rows. A tree gives no more centres than half a batch; where all cells' are too few,
further rows follow by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import blocks
from ..sources.shared import staged

#: Vectors of one batch, as doubles.
BATCH_BYTES = 64 << 20
_CENTRE = "cell long, batch long, id long, v array<double>, n double, angle double, far double"


def core_set(bank: DataFrame, n: int, bank_id: str = "bank_id", column: str = "embedding", batch_bytes: int | None = None) -> DataFrame:
    """``bank_id``, far, rows, angle of ``n`` rows that cover ``bank`` (all of them, if it has no more), from the least id.

    far is the cosine distance to the centres chosen before it at which a row was chosen (2 for the first one of a cell);
    rows is the number of rows that it stands for, which lie within ``angle`` (radians) of it. Distances are compared to 12
    decimals and ties go to the least id. Ids are longs; null ids and vectors are left out, repeated ids are rows of
    their own, and equal vectors are chosen only once all others are.
    """
    rows = bank.select(F.col(bank_id).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).head()
    batch = max(4, (BATCH_BYTES if batch_bytes is None else batch_bytes) // (8 * max(1, size.d or 1)))
    most = batch // 2
    n = max(0, n)
    if n <= most:
        found = _tree(rows.withColumn("cell", F.lit(0).cast("long")), size.n, n, batch)
    elif n >= size.n:
        found = rows.select("id", F.lit(0.0).alias("far"), F.lit(1.0).alias("n"), F.lit(0.0).alias("angle"))
    else:
        pivots = core_set(rows, min(most, -(-4 * n // most)), "id", "v", batch_bytes).select("id")
        cells = staged(_cells(rows, pivots), "cells")
        found = _first(_tree(cells, size.n, most, batch), n)
        short = n - found.count()
        if short > 0:  # cells of more rows than half a batch, such as very many equal vectors
            rest = cells.join(found.select("id"), "id", "left_anti").select("cell", "id", F.lit(0.0).alias("far"), F.lit(1.0).alias("n"), F.lit(0.0).alias("angle"))
            found = found.select("id", "far", "n", "angle").unionByName(_first(rest, short).select("id", "far", "n", "angle"))
    return found.select(F.col("id").alias(bank_id), "far", F.col("n").cast("long").alias("rows"), "angle")


def _greedy(n: int):
    """A group of rows to its at most ``n`` greedy centres."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        ids, x = t.column("id").to_numpy(), blocks.matrix(t.column("v"))
        order = np.argsort(ids, kind="stable")
        if (np.diff(ids[order]) == 0).any():
            order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], x[i].tobytes())))
        at, far, count, angle = blocks.k_centre_cover(blocks.unit_rows(x[order]), n, t.column("n").to_numpy()[order], t.column("angle").to_numpy()[order])
        rows = pa.array(order[at])
        return pa.table({"cell": t.column("cell").take(rows), "batch": t.column("batch").take(rows), "id": t.column("id").take(rows), "v": t.column("v").take(rows), "n": count, "angle": angle, "far": far})

    return run


def _tree(rows: DataFrame, total: int, n: int, batch: int) -> DataFrame:
    """Centres of each cell of ``rows`` (cell, id, v): at most ``n``, from batches of about ``batch`` rows."""
    if total <= batch:
        dealt, most = rows.withColumn("batch", F.lit(0).cast("long")), 1
    else:
        sizes = staged(rows.groupBy("cell").agg(F.ceil(F.count("*") / batch).alias("batches")), "cell-sizes")  # fewer than a batch's rows
        most = sizes.agg(F.max("batches")).head()[0] or 1
        dealt = rows.join(F.broadcast(sizes), "cell").withColumn("batch", F.pmod(F.xxhash64("id"), "batches"))
    level = dealt.select("cell", "batch", "id", "v", F.lit(1.0).alias("n"), F.lit(0.0).alias("angle"), F.lit(2.0).alias("far"))
    fan = max(2, batch // max(1, n))
    while True:
        level = staged(level.groupBy("cell", "batch").applyInArrow(_greedy(n), _CENTRE), "centres")
        if most <= 1:
            return level
        level, most = level.withColumn("batch", F.expr(f"batch div {fan}")), -(-most // fan)


def _cells(rows: DataFrame, pivots: DataFrame) -> DataFrame:
    """``rows`` with the number of their nearest pivot as cell. There are no more pivots (ids of rows) than half a batch."""
    got = rows.join(F.broadcast(pivots.distinct()), "id", "left_semi").groupBy("id").agg(F.min("v").alias("v")).orderBy("id").select("v").toArrow()
    shared = rows.sparkSession.sparkContext.broadcast(blocks.unit_rows(blocks.matrix(got.column(0))))

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                near = np.round(blocks.unit_rows(blocks.matrix(part.column(1))) @ shared.value.T, 12).argmax(1)
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int64)), part.column(0), part.column(1)], ["cell", "id", "v"])

    return rows.mapInArrow(run, "cell long, id long, v array<double>")


def _first(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows chosen at the largest distance, ties by id: whole tasks of a range sort, and part of one."""
    spark = rows.sparkSession
    order = [F.desc("far"), F.asc("id"), F.asc("cell")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = staged(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "centres-by-distance")
    last = -1
    for r in cut.groupBy(F.shiftright("at", 33).alias("task")).agg(F.count("*").alias("n")).orderBy("task").collect():  # one row a task
        take = min(n, r.n)
        n -= take
        last = (r.task << 33) + take - 1
        if not n:
            break
    return cut.where(F.col("at") <= last).drop("at")


def coreset(bank: DataFrame, n: int, bank_id: str = "bank_id", column: str = "embedding", batch_bytes: int | None = None) -> DataFrame:
    """The rows of ``bank`` that core_set() chooses."""
    return bank.join(core_set(bank, n, bank_id, column, batch_bytes).select(bank_id).distinct(), bank_id, "left_semi")


def cover_radius(bank: DataFrame, chosen: DataFrame, bank_id: str = "bank_id", column: str = "embedding") -> DataFrame:
    """One row: radius, the largest cosine distance of a row of ``bank`` to its nearest row of ``chosen``, and size, the rows chosen."""
    from .knn import knn_join

    found = knn_join(bank.withColumnRenamed(bank_id, "query_id"), chosen, 1, "query_id", bank_id, column)
    return found.agg((1 - F.min("similarity")).alias("radius"), F.lit(chosen.count()).cast("long").alias("size"))
