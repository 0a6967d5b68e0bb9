"""Ranking and detection metrics from scored rows, without a window over all rows.

Rows are first counted by distinct score. Running sums over those go through ranges of the score order: totals of
each range, then offsets of ranges, then sums inside a range, so no task ever holds a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import EPSILON
from ..sources.shared import staged
from .ranks import with_previous

RANGES = 64


def score_counts(rows: DataFrame, keys: list[str], score: str = "score", target: str = "target") -> DataFrame:
    """keys, score, t (positives), f (negatives) of each distinct score; null scores or targets are left out."""
    on = F.col(target).cast("int")
    return rows.where(F.col(score).isNotNull() & on.isNotNull()).groupBy(*keys, F.col(score).cast("double").alias("score")).agg(F.sum(on).alias("t"), F.sum(1 - on).alias("f"))


def running_counts(counts: DataFrame, keys: list[str], ranges: int = RANGES) -> DataFrame:
    """``counts`` with tp, fp (sums over scores at least as great), and p, n (the group's totals); the counts are made once."""
    counts = staged(counts, "score-counts")
    edges = counts.groupBy(*keys).agg(F.percentile_approx("score", [i / ranges for i in range(1, ranges)], 1000).alias("_e"), F.sum("t").alias("p"), F.sum("f").alias("n"))
    rows = counts.join(edges, keys) if keys else counts.join(edges, how="cross")
    rows = rows.withColumn("_r", F.size(F.filter("_e", lambda e: e < F.col("score")))).drop("_e")
    part = rows.groupBy(*keys, "_r").agg(F.sum("t").alias("_t"), F.sum("f").alias("_f"))
    above = W.partitionBy(*keys).orderBy(F.desc("_r")).rowsBetween(W.unboundedPreceding, -1)
    part = part.withColumns({"_ot": F.coalesce(F.sum("_t").over(above), F.lit(0)), "_of": F.coalesce(F.sum("_f").over(above), F.lit(0))}).drop("_t", "_f")
    inside = W.partitionBy(*keys, "_r").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.join(part, [*keys, "_r"])
    return rows.withColumns({"tp": F.sum("t").over(inside) + F.col("_ot"), "fp": F.sum("f").over(inside) + F.col("_of")}).drop("_r", "_ot", "_of")


def _trapezoid(x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    return (x1 - x0) * (y0 + y1) / 2


def ranking_metrics(rows: DataFrame, keys: list[str], score: str = "score", target: str = "target") -> DataFrame:
    """keys, auroc (tie-corrected), aupr (trapezoid over points of distinct scores, from recall 0 at the first precision), f1max.

    A group of one class only has null auroc; without positives also null aupr and f1max.
    """
    r = running_counts(score_counts(rows, keys, score, target), keys)
    tp0, fp0 = F.col("tp") - F.col("t"), F.col("fp") - F.col("f")
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    before = F.when(tp0 + fp0 > 0, tp0 / F.when(tp0 + fp0 > 0, tp0 + fp0)).otherwise(precision)
    pos, neg = F.when(F.max("p") > 0, F.max("p")), F.when(F.max("n") > 0, F.max("n"))
    return r.groupBy(*keys).agg(
        (F.sum(F.col("f") * (tp0 + F.col("t") / 2)) / (pos * neg)).alias("auroc"),
        (F.sum(F.col("t") * (before + precision) / 2) / pos).alias("aupr"),
        F.when(pos > 0, F.max(2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("p")))).alias("f1max"),
    )


def roc_curve(rows: DataFrame, keys: list[str], score: str = "score", target: str = "target") -> DataFrame:
    r = running_counts(score_counts(rows, keys, score, target), keys)
    return r.select(*keys, "score", (F.col("fp") / F.when(F.col("n") > 0, F.col("n"))).alias("fpr"), (F.col("tp") / F.when(F.col("p") > 0, F.col("p"))).alias("tpr"))


def pr_curve(rows: DataFrame, keys: list[str], images: DataFrame | None = None, score: str = "score", target: str = "target") -> DataFrame:
    """keys, score, precision, recall by falling score; recall is over the number of images (keys, n_images), else of positives."""
    r = running_counts(score_counts(rows, keys, score, target), keys)
    if images is not None:
        r = r.join(images.select(*keys, "n_images"), keys) if keys else r.join(images.select("n_images"), how="cross")
    whole = F.col("n_images") if images is not None else F.col("p")
    return r.select(*keys, "score", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / whole).alias("recall"))


def average_precision(curve: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ap: trapezoid area under a PR curve with (0, 1) before it and (last recall, 0) after it.

    The curve has a row for each distinct score; the last point adds no width, so only the first is added here.
    """
    rows = with_previous(curve.select(*keys, "score", "recall", "precision"), keys, [F.desc("score")], ["recall", "precision"])
    rows = rows.withColumns({"_r": F.coalesce("_prev_recall", F.lit(0.0)), "_p": F.coalesce("_prev_precision", F.lit(1.0))})
    return rows.groupBy(*keys).agg(F.sum(_trapezoid(F.col("_r"), F.col("recall"), F.col("_p"), F.col("precision"))).alias("ap"))


def auc(curve: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    rows = with_previous(curve.select(*keys, F.col(x).alias("_cx"), F.col(y).alias("_cy")), keys, [F.asc("_cx"), F.asc("_cy")], ["_cx", "_cy"], "_b")
    rows = rows.select(*keys, F.col("_cx").alias(x), F.col("_cy").alias(y), F.col("_b_cx").alias("_x"), F.col("_b_cy").alias("_y")).where("_x IS NOT NULL")
    return rows.groupBy(*keys).agg(F.sum(_trapezoid(F.col("_x"), F.col(x), F.col("_y"), F.col(y))).alias("auc"))


def aupro(pixels: DataFrame, keys: list[str], region: str = "region_id", score: str = "score", limit: float = 0.3) -> DataFrame:
    """keys, aupro: mean overlap of regions against the false positive rate, integrated up to ``limit`` and divided by it.

    ``pixels`` has the region of each pixel (null outside). A pixel of a region weighs 1 / (its size x regions), so the
    mean overlap at a score is one running sum, whatever the number of regions.
    """
    pixels = pixels.groupBy(*keys, region, F.col(score).cast("double").alias(score)).agg(F.count("*").alias("_c"))
    pixels = staged(pixels, "pixel-counts")
    size = pixels.where(F.col(region).isNotNull()).groupBy(*keys, region).agg(F.sum("_c").alias("_s"))
    n = size.groupBy(*keys).agg(F.count("*").alias("_n"))
    inside = pixels.where(F.col(region).isNotNull()).join(size, [*keys, region])
    inside = (inside.join(n, keys) if keys else inside.join(n, how="cross")).select(*keys, F.col(score).cast("double").alias("score"), (F.col("_c") / (F.col("_s") * F.col("_n"))).alias("t"), F.lit(0.0).alias("f"))
    outside = pixels.where(F.col(region).isNull()).select(*keys, F.col(score).cast("double").alias("score"), F.lit(0.0).alias("t"), F.col("_c").cast("double").alias("f"))
    c = inside.unionByName(outside).groupBy(*keys, "score").agg(F.sum("t").alias("t"), F.sum("f").alias("f"))
    r = running_counts(c, keys)
    x1, x0 = F.col("fp") / F.col("n"), (F.col("fp") - F.col("f")) / F.col("n")
    y1, y0 = F.col("tp"), F.col("tp") - F.col("t")
    cut = F.least(x1, F.lit(limit))
    y_cut = y0 + (y1 - y0) * F.when(x1 > x0, (cut - x0) / F.when(x1 > x0, x1 - x0)).otherwise(F.lit(1.0))
    area = F.when((F.col("n") > 0) & (x0 < limit), (cut - x0) * (y0 + y_cut) / 2).otherwise(0.0)
    return r.groupBy(*keys).agg((F.sum(area) / limit).alias("aupro"))


def match_metrics(counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys and precision, recall, f1, mean_iou, tp, fp, fn, count_error, n_pred, n_gt from tp, iou_sum, n_pred, n_gt; without truths the rates are null."""
    tp, p, g = F.col("tp"), F.col("n_pred"), F.col("n_gt")
    some = lambda v: F.when(g > 0, v)
    precision, recall = F.when(p > 0, tp / F.when(p > 0, p)).otherwise(0.0), tp / F.when(g > 0, g)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / F.when(precision + recall > 0, precision + recall)).otherwise(0.0)
    return counts.select(
        *keys, some(precision).alias("precision"), some(recall).alias("recall"), some(f1).alias("f1"),
        some(F.when(tp > 0, F.col("iou_sum") / F.when(tp > 0, tp)).otherwise(0.0)).alias("mean_iou"),
        tp.alias("tp"), (p - tp).alias("fp"), (g - tp).alias("fn"), F.abs(p - g).alias("count_error"), p.alias("n_pred"), g.alias("n_gt"),
    )


def method_summary(metrics: DataFrame, order: list[str] | None = None) -> DataFrame:
    """method and mean precision, recall, f1, mean_iou, count_error, nulls and NaN skipped; in ``order``, others last."""
    skip = lambda c: F.avg(F.when(~F.isnan(c), F.col(c))).alias(c)
    out = metrics.groupBy("method").agg(*[skip(c) for c in ("precision", "recall", "f1", "mean_iou")], F.avg("count_error").alias("count_error"))
    place = F.array_position(F.array(*map(F.lit, order or [""])), F.col("method"))
    return out.orderBy(F.when(place > 0, place).otherwise(1 << 30), "method")


def instance_stats(candidates: DataFrame, images: DataFrame, score_least: float, iou_least: float) -> DataFrame:
    """tp, fp, fn, tpr, precision over images: the best IoU among candidates of enough score is a hit or not; none is a miss."""
    best = candidates.where(F.col("score") >= score_least).groupBy("image_id").agg(F.max("iou").alias("_b"))
    rows = images.select("image_id").distinct().join(best, "image_id", "left")
    n = lambda c: F.count(F.when(c, 1))
    b = F.col("_b")
    out = rows.agg(n(b >= iou_least).alias("tp"), n(b < iou_least).alias("fp"), n(b.isNull()).alias("fn"))
    return out.select("tp", "fp", "fn", (F.col("tp") / (F.col("tp") + F.col("fn") + EPSILON)).alias("tpr"), (F.col("tp") / (F.col("tp") + F.col("fp") + EPSILON)).alias("precision"))


def iou_distribution(rows: DataFrame, keys: list[str], least: float, iou: str = "iou") -> DataFrame:
    return rows.groupBy(*keys).agg(F.avg(iou).alias("mean"), F.median(iou).alias("median"), F.max(iou).alias("max"), F.avg((F.col(iou) >= least).cast("double")).alias("share"))


def histogram(rows: DataFrame, keys: list[str], value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """keys, bin, n: counts in equal bins of [lo, hi], the last one closed; values outside are left out."""
    b = F.least(F.floor((F.col(value) - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("int")
    return rows.where(F.col(value).between(lo, hi)).groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"))


def image_pair_quality(pixels: DataFrame, keys: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """keys, mse, ncc over pixels where both values are positive."""
    both = pixels.where((F.col(a) > 0) & (F.col(b) > 0))
    ncc = F.covar_pop(a, b) / (F.stddev_pop(a) * F.stddev_pop(b) + 1e-12)
    return both.groupBy(*keys).agg(F.avg((F.col(a) - F.col(b)) ** 2).alias("mse"), ncc.alias("ncc"))
