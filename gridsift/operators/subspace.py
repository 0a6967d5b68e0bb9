"""Subspaces of embedding space: fitted from sums over all rows, applied in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import blocks


def _rows(column: pa.Array) -> np.ndarray:
    return np.asarray(column.to_pylist(), float)


def gram(df: DataFrame, column: str = "embedding", normalise: bool = True) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, their sum and D x D Gram matrix: D + 1 vectors a task, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]):
        n, s, g = 0, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _rows(batch.column(0))
            x = blocks.unit_rows(x) if normalise else x
            n, s, g = n + len(x), x.sum(0) + (0 if s is None else s), x.T @ x + (0 if g is None else g)
        if n:
            d = len(s)
            values = np.vstack((np.append(s, n), np.concatenate((g, np.zeros((d, 1))), 1)))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, d + 1), pa.int32()), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d + 1, dtype=np.int32)), flat], ["i", "v"])

    parts = df.select(column).where(F.col(column).isNotNull()).mapInArrow(run, "i int, v array<double>")
    total = parts.groupBy("i").agg(Summarizer.sum(array_to_vector("v")).alias("v")).select("i", vector_to_array("v").alias("v")).orderBy("i").toArrow()  # D + 1 rows
    if not total.num_rows:
        raise ValueError("no rows to fit a subspace to")
    v = np.array(total.column(1).to_pylist())
    return int(v[0, -1]), v[0, :-1], v[1:, :-1]


#: Vectors of more numbers are fitted by a sketch, if few directions are asked for.
WIDE = 256
#: Directions of a sketch beyond those asked for, and its passes over the rows.
EXTRA, PASSES = 10, 4


def _products(df: DataFrame, q: np.ndarray, column: str, normalise: bool) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, their sum, and the sum of x (x'q): D rows of a few numbers a task, added up by Spark."""
    shared = df.sparkSession.sparkContext.broadcast(q)

    def run(batches: Iterator[pa.RecordBatch]):
        n, s, y = 0, 0.0, 0.0
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                x = _rows(batch.column(0).slice(i, 1024))
                x = blocks.unit_rows(x) if normalise else x
                n, s, y = n + len(x), s + x.sum(0), y + x.T @ (x @ shared.value)
        if n:
            values = np.column_stack((np.full(len(s), float(n)), s, y))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1]), pa.int32()), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(s), dtype=np.int32)), flat], ["i", "v"])

    parts = df.select(column).where(F.col(column).isNotNull()).mapInArrow(run, "i int, v array<double>")
    total = parts.groupBy("i").agg(Summarizer.sum(array_to_vector("v")).alias("v")).select("i", vector_to_array("v").alias("v")).orderBy("i").toArrow()  # D rows
    v = blocks.matrix(total.column(1))
    return int(v[0, 0]), v[:, 1], v[:, 2:]


def sketch_subspace(df: DataFrame, k: int, column: str = "embedding", normalise: bool = True, passes: int = PASSES, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As fit_subspace(), by a randomised range finder: each pass multiplies the covariance with k + EXTRA directions.

    A task sends D x (k + EXTRA) numbers in place of D x D. The directions start from a seeded sample and are orthonormal
    after each pass; the last pass gives the variances inside what they span.
    """
    first = df.select(F.size(column).alias("d")).where("d >= 0").head()
    if first is None:
        raise ValueError("no rows to fit a subspace to")
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(first.d, min(first.d, k + EXTRA))))
    for i in range(passes):
        n, s, y = _products(df, q, column, normalise)
        mean = s / n
        y = y / n - np.outer(mean, mean @ q)
        if i < passes - 1:
            q, _ = np.linalg.qr(y)
    small = q.T @ y
    value, vector = np.linalg.eigh((small + small.T) / 2)
    v = (q @ vector[:, ::-1][:, :k]).T
    return mean, v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])[:, None], np.maximum(value[::-1][:k], 0)


def fit_subspace(df: DataFrame, k: int, column: str = "embedding", normalise: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, top k directions (rows; the greatest loading positive) and variances of the (normalised) vectors.

    Exact from the Gram matrix; vectors wider than ``WIDE`` of which few directions are asked for go by sketch_subspace().
    """
    first = df.select(F.size(column).alias("d")).where("d >= 0").head()
    if first is not None and first.d > WIDE and 4 * (k + EXTRA) < first.d:
        return sketch_subspace(df, k, column, normalise)
    n, s, g = gram(df, column, normalise)
    mean = s / n
    value, vector = np.linalg.eigh(g / n - np.outer(mean, mean))
    v = vector[:, ::-1][:, :k].T
    v = v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])[:, None]
    return mean, v, np.maximum(value[::-1][:k], 0)


def _map(df: DataFrame, f, column: str, to: str) -> DataFrame:
    place = df.columns.index(column)
    schema = T.StructType([x for x in df.schema.fields if x.name != to] + [T.StructField(to, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            out = pa.array(f(_rows(batch.column(place))).tolist() if batch.num_rows else [], pa.list_(pa.float64()))
            keep = [i for i, n in enumerate(batch.schema.names) if n != to]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), out], schema.names)

    return df.mapInArrow(run, schema)


def remove_subspace(df: DataFrame, basis: np.ndarray, column: str = "embedding") -> DataFrame:
    """x - B'(Bx), renormalised, for orthonormal rows B."""
    b = df.sparkSession.sparkContext.broadcast(basis)
    return _map(df, lambda x: blocks.unit_rows(x - (x @ b.value.T) @ b.value), column, column)


def project(df: DataFrame, mean: np.ndarray, components: np.ndarray, column: str = "embedding", to: str = "projection", normalise: bool = False) -> DataFrame:
    b = df.sparkSession.sparkContext.broadcast((mean, components))
    return _map(df, lambda x: ((blocks.unit_rows(x) if normalise else x) - b.value[0]) @ b.value[1].T, column, to)


def whiten(df: DataFrame, mean: np.ndarray, components: np.ndarray, variances: np.ndarray, eps: float = 1e-6, column: str = "embedding") -> DataFrame:
    """Projections over the square root of variance + eps, normalised."""
    b = df.sparkSession.sparkContext.broadcast((mean, components / np.sqrt(variances + eps)[:, None]))
    return _map(df, lambda x: blocks.unit_rows((x - b.value[0]) @ b.value[1].T), column, column)


def pca_foreground(patches: DataFrame, keys: list[str], n: int = 1, threshold: float = 0.0) -> DataFrame:
    """keys, row, col, projection (n values), foreground: a PCA of each image's own patches; foreground is a first value above ``threshold``."""
    kinds = dict(patches.dtypes)

    def run(t: pa.Table) -> pa.Table:
        x = _rows(t.column("embedding"))
        mean, v, _ = blocks.principal(x, n)
        p = (x - mean) @ v.T
        return t.select([*keys, "row", "col"]).append_column("projection", pa.array(p.tolist(), pa.list_(pa.float64()))).append_column("foreground", pa.array(p[:, 0] > threshold))

    schema = ", ".join(f"{k} {kinds[k]}" for k in (*keys, "row", "col")) + ", projection array<double>, foreground boolean"
    return patches.select(*keys, "row", "col", "embedding").groupBy(*keys).applyInArrow(run, schema)


def fgbg_classifier(bank: DataFrame, patches: DataFrame, hidden: int = 16, rounds: int = 50, seed: int = 0) -> DataFrame:
    """``patches`` with score, the probability of foreground, by a small perceptron fitted to a bank with is_fg."""
    d = bank.select(F.size("embedding")).head()[0]
    as_vector = lambda t: t.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))
    model = MultilayerPerceptronClassifier(layers=[d, hidden, 2], maxIter=rounds, seed=seed, labelCol="label").fit(as_vector(bank).withColumn("label", F.col("is_fg").cast("double")))
    out = model.transform(as_vector(patches))
    return out.withColumn("score", F.get(vector_to_array("probability"), F.lit(1))).drop("features", "rawPrediction", "probability", "prediction")
