"""Exact nearest neighbours in a bank too large to broadcast: a Voronoi index over pivots, pruned by angles.

Bank rows go to the nearest of a bounded number of pivots, rows of the bank picked by hash. A cell is cut into bounded
blocks by angle to its pivot, and each block knows the range of these angles. The angle is a metric, so for a query at angle
t from a cell's pivot no row of a block with angles [a, b] is nearer than max(t - b, a - t); and since a row of a cell is
no nearer to the query's own pivot (at angle s) than to its cell's, nor nearer than (t - s) / 2.

Each query meets the blocks with the least bounds first, until they hold k rows: that gives an angle within which its k
nearest lie. Then it meets the other blocks whose bound does not exceed that angle, and the partial results are merged.
A query vector is copied once for each block that it meets, and a block once for each bounded chunk of its queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import blocks
from ..sources.shared import staged
from .retrieval import top_per_group

#: Most pivots, and most bytes of their vectors as doubles, which every task holds.
PIVOTS, PIVOT_BYTES = 1024, 32 << 20
#: Vectors of one block, or of one chunk of queries, as doubles; a task holds both, and each once more as unit rows.
BLOCK_BYTES = 32 << 20
#: Bounds of queries to blocks that a task holds at once, and most bytes of query vectors that it hands on at once.
BOUNDS, OUT_BYTES = 2_000_000, 8 << 20
#: Bounds are lowered by so many radians, more than rounding makes of equal vectors.
SLACK = 1e-6
_FOUND = "query_id long, bank_id long, similarity double"


@dataclass
class Index:
    """Bank rows by block (block, bank_id, v), unit pivots, and for each block its pivot, its angles' range and its number of rows."""

    rows: DataFrame
    pivots: np.ndarray
    pivot: np.ndarray
    least: np.ndarray
    most: np.ndarray
    size: np.ndarray

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """Least angles of unit rows ``x`` to each block."""
        t = np.arccos(np.clip(x @ self.pivots.T, -1, 1))
        own = t.min(1, keepdims=True)
        b = t[:, self.pivot]
        return np.maximum(np.maximum(b - self.most, self.least - b), (b - own) / 2) - SLACK


def build(bank: DataFrame, rows: int, width: int, pivots: int | None = None, block_rows: int | None = None) -> Index:
    """The index of ``bank`` (bank_id, v), which has ``rows`` rows of ``width`` numbers. There are O(rows / block_rows + pivots) blocks."""
    spark = bank.sparkSession
    block_rows = block_rows or max(1, BLOCK_BYTES // (8 * width))
    n = pivots or max(1, min(PIVOTS, PIVOT_BYTES // (8 * width), -(-4 * rows // block_rows)))
    got = bank.orderBy(F.xxhash64("bank_id"), "bank_id").select("v").limit(n).toArrow()  # n rows a task at most
    p = blocks.unit_rows(blocks.matrix(got.column(0)))
    shared = spark.sparkContext.broadcast(p)

    def place(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                s = blocks.unit_rows(blocks.matrix(part.column(1))) @ shared.value.T
                cell = s.argmax(1)
                angle = np.arccos(np.clip(s[np.arange(len(s)), cell], -1, 1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cell.astype(np.int64)), pa.array(angle)], ["bank_id", "v", "cell", "angle"])

    placed = staged(bank.mapInArrow(place, "bank_id long, v array<double>, cell long, angle double"), "cells")
    cells = placed.groupBy("cell").agg(F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.ceil(F.count("*") / block_rows).alias("rings"))
    ring = F.least(F.col("rings") - 1, F.floor((F.col("angle") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-12)) * F.col("rings")))
    ringed = placed.join(F.broadcast(cells), "cell").withColumn("ring", ring.cast("long")).drop("lo", "hi", "rings")  # one row a pivot
    parts = ringed.groupBy("cell", "ring").agg(F.ceil(F.count("*") / block_rows).alias("parts"))
    whole = ringed.join(F.broadcast(parts), ["cell", "ring"]).withColumn("part", F.pmod(F.xxhash64("bank_id"), "parts"))  # fewer than blocks
    known = whole.groupBy("cell", "ring", "part").agg(F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.count("*").alias("n")).orderBy("cell", "ring", "part").collect()
    numbers = spark.createDataFrame([(r.cell, r.ring, r.part, i) for i, r in enumerate(known)], "cell long, ring long, part long, block long")
    rows_of = whole.join(F.broadcast(numbers), ["cell", "ring", "part"]).select("block", "bank_id", "v")
    column = lambda c, t: np.array([r[c] for r in known], t)
    return Index(rows_of, p, column("cell", int), column("lo", float), column("hi", float), column("n", int))


def _meet(index: Index, met: DataFrame, k: int, chunk: int) -> DataFrame:
    """query_id, bank_id, similarity: the k nearest of each (block, query_id, v) row's block."""
    load = met.groupBy("block").agg(F.ceil(F.count("*") / chunk).alias("chunks"))  # one row a block
    q = met.join(F.broadcast(load), "block").withColumn("chunk", F.pmod(F.xxhash64("query_id"), "chunks")).drop("chunks")
    b = index.rows.join(F.broadcast(load), "block").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).drop("chunks")

    def both(x: pa.Table, y: pa.Table) -> pa.Table:
        out = [pa.table({"query_id": pa.array([], pa.int64()), "bank_id": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})]
        if x.num_rows and y.num_rows:
            y = y.take(pa.array(np.argsort(y.column("bank_id").to_numpy(), kind="stable")))
            bank_ids, m = y.column("bank_id").to_numpy(), blocks.unit_rows(blocks.matrix(y.column("v")))
            for s in range(0, x.num_rows, 512):
                part = x.slice(s, 512)
                found, value = blocks.nearest_rows(blocks.unit_rows(blocks.matrix(part.column("v"))), m, bank_ids, k)
                out.append(pa.table({"query_id": np.repeat(part.column("query_id").to_numpy(), found.shape[1]), "bank_id": found.ravel(), "similarity": value.ravel()}))
        return pa.concat_tables(out)

    return q.groupBy("block", "chunk").cogroup(b.groupBy("block", "chunk")).applyInArrow(both, _FOUND)


def _routed(query: DataFrame, index: Index, k: int, later: bool) -> DataFrame:
    """block, query_id, v: each query with the blocks of its first round, or with the further ones that its angle leaves.

    ``query`` has query_id, v and for the further ones angle, within which the k nearest lie.
    """
    shared = query.sparkSession.sparkContext.broadcast((index.pivots, index.pivot, index.least, index.most, index.size))

    def run(batches: Iterator[pa.RecordBatch]):
        own = Index(None, *shared.value)
        for b in batches:
            step = max(1, BOUNDS // max(1, len(own.pivot)))
            for i in range(0, b.num_rows, step):
                part = b.slice(i, step)
                bound = own.bounds(blocks.unit_rows(blocks.matrix(part.column(1))))
                order = np.argsort(bound, axis=1, kind="stable")
                before = np.cumsum(own.size[order], axis=1) - own.size[order]
                first = np.zeros(bound.shape, bool)
                np.put_along_axis(first, order, before < k, 1)
                wanted = ~first & (bound <= part.column(2).to_numpy()[:, None]) if later else first
                row, block = np.nonzero(wanted)
                out = max(1, OUT_BYTES // (8 * own.pivots.shape[1]))
                for s in range(0, len(row), out):
                    take = pa.array(row[s : s + out])
                    yield pa.RecordBatch.from_arrays([pa.array(block[s : s + out].astype(np.int64)), part.column(0).take(take), part.column(1).take(take)], ["block", "query_id", "v"])

    return query.mapInArrow(run, "block long, query_id long, v array<double>")


def nearest(query: DataFrame, index: Index, k: int, width: int, chunk_rows: int | None = None) -> DataFrame:
    """query_id, rank, bank_id, similarity of the ``k`` nearest rows of ``index`` of each (query_id, v), ties by bank_id. Query ids are distinct."""
    chunk = chunk_rows or max(1, BLOCK_BYTES // (8 * width))
    order = [F.desc("similarity"), F.asc("bank_id")]
    first = staged(top_per_group(_meet(index, _routed(query, index, k, False), k, chunk), ["query_id"], k, order), "first-round")
    kth = first.where(F.col("rank") == k).select("query_id", (F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), "similarity"))) + SLACK).alias("angle"))
    left = query.join(kth, "query_id").select("query_id", "v", "angle")  # without k rows, a query has met all blocks
    more = _meet(index, _routed(left, index, k, True), k, chunk)
    return top_per_group(first.drop("rank").unionByName(more), ["query_id"], k, order).select("query_id", "rank", "bank_id", "similarity")


def pairs(query: DataFrame, index: Index, k: int, width: int) -> DataFrame:
    """One row: pairs of a query and a bank row that nearest() compares, and all of them."""
    sizes = query.sparkSession.createDataFrame([(i, int(n)) for i, n in enumerate(index.size)], "block long, rows long")
    found = nearest(query, index, k, width).where(F.col("rank") == k).select("query_id", (F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), "similarity"))) + SLACK).alias("angle"))
    final = query.join(found, "query_id", "left").select("query_id", "v", F.coalesce("angle", F.lit(4.0)).alias("angle"))
    met = _routed(query, index, k, False).select("block").unionByName(_routed(final, index, k, True).select("block"))
    return met.join(F.broadcast(sizes), "block").agg(F.sum("rows").alias("compared"), (F.lit(query.count()) * int(index.size.sum())).alias("all"))
