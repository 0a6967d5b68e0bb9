"""Column functions on embedding arrays (FLOAT on disk, DOUBLE in computation), all inside the JVM."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least norm in normalising; summand in cosine denominators and IoU unions.
LEAST_NORM, EPSILON = 1e-12, 1e-8


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: str | Column, soft: bool = False) -> Column:
    """x / max(|x|, 1e-12), or with ``soft`` x / (|x| + 1e-8)."""
    n = norm(a) + EPSILON if soft else F.greatest(norm(a), F.lit(LEAST_NORM))
    return F.transform(a, lambda x: x.cast("double") / n)


def cosine(a: str | Column, b: str | Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + EPSILON)


def unit(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``column`` normalised; the norm is computed once a row."""
    return df.withColumn("_norm", F.greatest(norm(column), F.lit(LEAST_NORM))).withColumn(column, F.transform(column, lambda x: x.cast("double") / F.col("_norm"))).drop("_norm")


def mean_vector(column: str | Column) -> Column:
    """An aggregate: the mean vector, with partial sums on the map side."""
    c = F.col(column) if isinstance(column, str) else column
    return Summarizer.mean(array_to_vector(c.cast("array<double>")))


def vector_mean(df: DataFrame, keys: list[str], column: str = "embedding", normalise: bool = True) -> DataFrame:
    """Mean vector of each group of ``keys`` as ``column``, normalised or not; empty input gives no row."""
    out = df.groupBy(*keys).agg(mean_vector(column).alias("_m")).select(*keys, vector_to_array("_m").alias(column))
    out = out.where(F.size(column) > 0)
    return unit(out, column) if normalise else out


def weighted_vector_mean(df: DataFrame, keys: list[str], weight: str, column: str = "embedding", normalise: bool = True) -> DataFrame:
    """As vector_mean(), weighted by a column of positive weights."""
    agg = Summarizer.metrics("mean").summary(array_to_vector(F.col(column).cast("array<double>")), F.col(weight).cast("double"))
    out = df.where(F.col(weight) > 0).groupBy(*keys).agg(agg.alias("_s")).select(*keys, vector_to_array("_s.mean").alias(column))
    return unit(out, column) if normalise else out


def rounded(column: str | Column, digits: int = 6) -> Column:
    """A vector with its values rounded, for comparing results."""
    return F.transform(column, lambda x: F.round(x, digits) + F.lit(0.0))
