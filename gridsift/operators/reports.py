"""Report tables over scores and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import EPSILON, dot, vector_mean
from .ranks import numbered


def pivot_metric(rows: DataFrame, index: str, column: str, value: str, columns: list[str] | None = None) -> DataFrame:
    """One row for each ``index``, a column for each method; given names save a pass over the data."""
    return rows.groupBy(index).pivot(column, columns).agg(F.first(value, ignorenulls=True))


def cross_scale_matrix(rows: DataFrame, scales: list[str]) -> DataFrame:
    """Mean IoU by roi_source and score_scale, over rows with a truth."""
    return rows.where("gt_present").groupBy("roi_source").pivot("score_scale", scales).agg(F.avg("iou"))


def cross_score(scores: DataFrame, tuned: DataFrame) -> DataFrame:
    """crop, scale, iou, gt_present: IoU of score > the scale's tuned threshold with the crop's truth cells."""
    rows = scores.join(tuned.select("scale", "threshold"), "scale")
    on, t = F.col("score") > F.col("threshold"), F.col("truth")
    n = lambda c: F.count(F.when(c, 1))
    return rows.groupBy("crop", "scale").agg((n(on & t) / (n(on | t) + EPSILON)).alias("iou"), (n(t) > 0).alias("gt_present"))


def best_worst(rows: DataFrame, keys: list[str], n: int, score: str = "image_score", image: str = "image_id") -> DataFrame:
    """keys, image, score, side: the n lowest ('worst') and highest ('best') scores of anomalous rows."""
    rows = rows.where("label_index = 1")
    side = lambda name, o: rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(o, image))).where(F.col("_r") <= n).select(*keys, image, score, F.lit(name).alias("side"), F.col("_r").alias("rank"))
    return side("worst", F.asc(score)).unionByName(side("best", F.desc(score)))


def best_over_baseline(rows: DataFrame, keys: list[str], index: str, score: str) -> DataFrame:
    """keys, index, score, delta, rank: each group's first best row, its gain over the group's row 0, ranked by gain."""
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(index, score), F.struct((-F.col(score)).alias("s"), index)).alias("_b"), F.max(F.when(F.col(index) == 0, F.col(score))).alias("_0"))
    out = best.select(*keys, f"_b.{index}", f"_b.{score}", (F.col(f"_b.{score}") - F.col("_0")).alias("delta"))
    return numbered(out, [F.desc("delta"), *map(F.col, keys)], "rank").withColumn("rank", F.col("rank").cast("int"))


def best_candidate(rows: DataFrame, keys: list[str], iou_least: float) -> DataFrame:
    """keys, candidate_id, score, iou, hit of each group's candidate of the highest score, the first of equals."""
    b = rows.groupBy(*keys).agg(F.min_by(F.struct("candidate_id", "score", "iou"), F.struct((-F.col("score")).alias("s"), "candidate_id")).alias("_b"))
    return b.select(*keys, "_b.*", (F.col("_b.iou") >= iou_least).alias("hit"))


def side_by_side(rows: DataFrame, method: str, methods: list[str], n: int) -> DataFrame:
    """The first n anomalous images of one method, with every method's score in a column of its own."""
    first = rows.where((F.col("method") == method) & (F.col("label_index") == 1)).select("image_id").distinct().orderBy("image_id").limit(n)
    return rows.join(first, "image_id", "left_semi").groupBy("image_id").pivot("method", methods).agg(F.first("image_score"))


def baseline_join(rows: DataFrame, keys: list[str], index: str, column: str) -> DataFrame:
    """``rows`` with ``column`` of their group's row 0 as base."""
    base = rows.where(F.col(index) == 0).select(*keys, F.col(column).alias("base"))
    return rows.join(base, keys)


def seam_stats(similar: DataFrame, keys: list[str], axis: str, tile: int, last: int) -> DataFrame:
    """keys, and mean and deviation of similarities across tile seams and within tiles.

    A similarity at c is to c + 1. Positions beside a seam (c and c - 1) count as not within, and the last is skipped.
    """
    c = F.col(axis)
    rows = similar.where(c < last)
    seam = ((c + 1) % tile == 0)
    within = ~seam & (c % tile != 0)
    v = F.col("similarity")
    f = lambda on, name: [F.avg(F.when(on, v)).alias(f"{name}_mean"), F.stddev_pop(F.when(on, v)).alias(f"{name}_std"), F.count(F.when(on, 1)).alias(f"{name}_n")]
    return rows.groupBy(*keys).agg(*f(seam, "seam"), *f(within, "within"))


def mean_pairwise_similarity(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, mean_similarity over all pairs of different unit rows, from the mean vector: (|sum|^2 - n) / (n (n - 1))."""
    from ..functions.vectors import unit

    u = unit(vectors.select(*keys, "embedding"), "embedding")
    n = u.groupBy(*keys).agg(F.count("*").alias("n"))
    m = vector_mean(u, keys, normalise=False)
    s = dot("embedding", "embedding") * F.col("n") * F.col("n")
    return m.join(n, keys).select(*keys, "n", ((s - F.col("n")) / F.when(F.col("n") > 1, F.col("n") * (F.col("n") - 1))).alias("mean_similarity"))


def map_stats(maps: DataFrame, keys: list[str]) -> DataFrame:
    return maps.groupBy(*keys).agg(F.max("score").alias("max"), F.count(F.when(F.col("score") != 0, 1)).alias("nonzero"))


def run_summary(rows: DataFrame, meta: DataFrame) -> DataFrame:
    """category, method, mean_latency_ms, n_test, fit_s from score records and run metadata."""
    s = rows.where("split = 'test'").groupBy("category", "method").agg(F.avg("latency_ms").alias("mean_latency_ms"), F.count("*").alias("n_test"))
    return s.join(meta.select("category", "method", "fit_s"), ["category", "method"], "left")
