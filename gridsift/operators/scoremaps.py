"""Score maps (keys, row, col, score): peaks, thresholds, keypoints, projections."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import blocks
from ..functions.geometry import patch_to_point
from ..functions.vectors import EPSILON, vector_mean, weighted_vector_mean
from .ranks import joined, quantiles, with_range


def density(score: str, threshold: float):
    return F.greatest(F.col(score) - threshold, F.lit(0.0))


def peaks(maps: DataFrame, keys: list[str], kernel: int = 3, least: float = 0.0) -> DataFrame:
    """Cells that are the maximum of their kernel x kernel neighbourhood and above ``least``: separable running maxima."""
    if kernel % 2 == 0:
        raise ValueError("the kernel must be odd")
    r = kernel // 2
    w = lambda by, order: W.partitionBy(*keys, by).orderBy(order).rangeBetween(-r, r)
    rows = maps.repartition(*keys).withColumn("_m", F.max("score").over(w("row", "col")))
    return rows.withColumn("_m", F.max("_m").over(w("col", "row"))).where((F.col("score") == F.col("_m")) & (F.col("score") > least)).drop("_m")


def threshold_sweep(maps: DataFrame, keys: list[str], steps: int, truth: str = "truth") -> DataFrame:
    """keys, threshold (the first of best IoU), best_iou, over candidates on linspace(min, max, steps) with score > c.

    One pass: each cell is counted at the last candidate below its score, then counts are summed from above; so the
    work does not grow with cells x candidates.
    """
    rows = with_range(maps, keys, "score")
    step = (F.col("_hi") - F.col("_lo")) / (steps - 1)
    at = lambda i: F.col("_lo") + i * step
    near = F.when(step > 0, F.ceil((F.col("score") - F.col("_lo")) / step) - 1).otherwise(F.lit(-1)).cast("int")
    fixed = F.when(at(F.col("_k") + 1) < F.col("score"), F.col("_k") + 1).when((F.col("_k") >= 0) & (at(F.col("_k")) >= F.col("score")), F.col("_k") - 1).otherwise(F.col("_k"))
    rows = rows.withColumn("_k", near).withColumn("_k", F.least(fixed, F.lit(steps - 1)))
    count = rows.groupBy(*keys, "_k").agg(F.count("*").alias("n"), F.sum(F.col(truth).cast("int")).alias("t"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
    sums = count.groupBy(*keys).agg(F.sum("t").alias("_all"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"), F.collect_list(F.struct("_k", "n", "t")).alias("_c"))
    grid = sums.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    over = F.filter("_c", lambda c: c["_k"] >= F.col("i"))
    total = lambda field: F.aggregate(F.transform(over, lambda c: c[field]), F.lit(0).cast("long"), lambda s, v: s + v)
    n, t = total("n"), total("t")
    grid = grid.select(*keys, "i", at(F.col("i")).alias("c"), (t / (n + F.col("_all") - t + EPSILON)).alias("iou"))
    best = F.min_by(F.struct("c", "iou"), F.struct((-F.col("iou")).alias("x"), "i"))
    return grid.groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col("_b.c").alias("threshold"), F.col("_b.iou").alias("best_iou"))


def pooled_threshold(maps: DataFrame, keys: list[str], steps: int) -> DataFrame:
    return threshold_sweep(maps, keys, steps)


def gt_score_threshold(maps: DataFrame, keys: list[str], method: str, margin: float = 0.0, truth: str = "truth") -> DataFrame:
    """keys, threshold from true and false scores: 'mean', 'median' or 'min' of the true less a margin, 'max_false' plus it, 'midpoint', or 'youden'."""
    t, f = F.when(F.col(truth), F.col("score")), F.when(~F.col(truth), F.col("score"))
    simple = {
        "mean": F.avg(t) - margin, "min": F.min(t) - margin,
        "max_false": F.max(f) + margin, "midpoint": (F.avg(t) + F.avg(f)) / 2,
    }
    if method in simple:
        return maps.groupBy(*keys).agg(simple[method].alias("threshold"))
    if method == "median":
        return quantiles(maps, keys, {"threshold": (t, 0.5)}).withColumn("threshold", F.col("threshold") - margin)
    if method != "youden":
        raise ValueError(f"unknown method {method!r}")
    g = maps.groupBy(*keys, "score").agg(F.sum(F.col(truth).cast("int")).alias("t"), F.sum((~F.col(truth)).cast("int")).alias("f"))
    down = W.partitionBy(*keys).orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*keys)
    rows = g.withColumns({"_t": F.sum("t").over(down), "_f": F.sum("f").over(down), "_p": F.sum("t").over(whole), "_n": F.sum("f").over(whole)})
    j = F.col("_t") / F.col("_p") - F.col("_f") / F.col("_n")
    return rows.withColumn("_j", j).groupBy(*keys).agg(F.min_by("score", F.struct((-F.round("_j", 12)).alias("j"), "score")).alias("threshold"))


def cluster_size_bounds(sizes: DataFrame, keys: list[str], method: str, m: float = 0.0, k: float = 1.0) -> DataFrame:
    """keys, lo, hi of cluster sizes: 'median', 'range', 'std' (population) or 'quartiles'; half-even rounded, at least 2."""
    s = F.col("size").cast("double")
    floor = lambda x: F.greatest(F.bround(x), F.lit(2)).cast("int")
    if method in ("median", "quartiles"):
        a, b = (0.5, 0.5) if method == "median" else (0.25, 0.75)
        found = quantiles(sizes, keys, {"lo": (s, a), "hi": (s, b)})
        return found.select(*keys, floor(F.col("lo") - m).alias("lo"), floor(F.col("hi") + m).alias("hi"))
    lo, hi = {"range": (F.min(s) - m, F.max(s) + m), "std": (F.avg(s) - k * F.stddev_pop(s), F.avg(s) + k * F.stddev_pop(s))}[method]
    return sizes.groupBy(*keys).agg(floor(lo).alias("lo"), floor(hi).alias("hi"))


def true_false_split(maps: DataFrame, keys: list[str], truth: str = "truth") -> DataFrame:
    t, f = F.when(F.col(truth), F.col("score")), F.when(~F.col(truth), F.col("score"))
    stats = lambda side, c: [g(c).alias(f"{side}_{n}") for n, g in (("min", F.min), ("mean", F.avg), ("max", F.max))]
    medians = quantiles(maps, keys, {"true_median": (t, 0.5), "false_median": (f, 0.5)})
    found = joined(maps.groupBy(*keys).agg(*stats("true", t), *stats("false", f)), medians, keys)
    return found.select(*keys, *[f"{side}_{n}" for side in ("true", "false") for n in ("min", "mean", "median", "max")])


def otsu_threshold(maps: DataFrame, keys: list[str]) -> DataFrame:
    """keys, threshold: Otsu's cut of an 8-bit histogram (values cut to integers), scaled back; of a flat map, its minimum."""
    w = W.partitionBy(*keys)
    rows = with_range(maps, keys, "score")
    b = F.when(F.col("_hi") > F.col("_lo"), ((F.col("score") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 255).cast("int")).otherwise(0)
    h = rows.groupBy(*keys, b.alias("b")).agg(F.count("*").alias("n"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
    up = w.orderBy("b").rowsBetween(W.unboundedPreceding, 0)
    h = h.withColumns({"_n": F.sum("n").over(up), "_s": F.sum(F.col("b") * F.col("n")).over(up), "_nn": F.sum("n").over(w), "_ss": F.sum(F.col("b") * F.col("n")).over(w)})
    n2 = F.col("_nn") - F.col("_n")
    d = F.col("_s") / F.col("_n") - (F.col("_ss") - F.col("_s")) / F.when(n2 > 0, n2)
    h = h.withColumn("_v", F.coalesce(F.col("_n") * n2 * d * d, F.lit(-1.0)))
    best = h.groupBy(*keys).agg(F.min_by("b", F.struct((-F.round("_v", 6)).alias("v"), "b")).alias("b"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
    return best.select(*keys, F.when(F.col("_hi") > F.col("_lo"), F.col("_lo") + F.col("b") / 255 * (F.col("_hi") - F.col("_lo"))).otherwise(F.col("_lo")).alias("threshold"))


def roi_mask(maps: DataFrame, keys: list[str], method: str, value: float | None = None) -> DataFrame:
    """Cells with a score above a cut: 'otsu', 'fixed' (value) or 'percentile' (value in 0..100, linear)."""
    if method == "fixed":
        return maps.where(F.col("score") > value)
    cut = otsu_threshold(maps, keys) if method == "otsu" else quantiles(maps, keys, {"threshold": (F.col("score"), value / 100)})
    return maps.join(cut, keys).where(F.col("score") > F.col("threshold")).drop("threshold")


def minmax_scale(maps: DataFrame, keys: list[str]) -> DataFrame:
    rows = with_range(maps, keys, "score")
    return rows.withColumn("score", (F.col("score") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + EPSILON)).drop("_lo", "_hi")


def localize_keypoint(maps: DataFrame, keys: list[str], sigma: float, beta: float) -> DataFrame:
    """keys, x, y: soft-argmax of a map under a Gaussian around its first maximum, in cells; beta must be positive."""
    if beta <= 0:
        raise ValueError("beta must be positive")
    top = maps.groupBy(*keys).agg(F.min_by(F.struct("row", "col", "score"), F.struct((-F.col("score")).alias("s"), "row", "col")).alias("_t"))
    d2 = (F.col("row") - F.col("_t.row")) ** 2 + (F.col("col") - F.col("_t.col")) ** 2
    w = F.exp((F.col("score") - F.col("_t.score")) / beta) * F.exp(-d2 / (2 * sigma * sigma))
    rows = maps.join(top, keys).withColumn("_w", w)
    return rows.groupBy(*keys).agg((F.sum(F.col("col") * F.col("_w")) / F.sum("_w")).alias("x"), (F.sum(F.col("row") * F.col("_w")) / F.sum("_w")).alias("y"))


def find_keypoints(scores: DataFrame, keys: list[str], height: str, width: str, grid: int) -> DataFrame:
    """keys, x, y, similarity: the point of each map's best cell (the first of equals)."""
    top = scores.groupBy(*keys).agg(F.min_by(F.struct("row", "col", "score", height, width), F.struct((-F.col("score")).alias("s"), "row", "col")).alias("_t"))
    return top.select(*keys, patch_to_point(F.col("_t.col"), F.col(f"_t.{width}"), grid).alias("x"), patch_to_point(F.col("_t.row"), F.col(f"_t.{height}"), grid).alias("y"), F.col("_t.score").alias("similarity"))


def splat_max(coarse: DataFrame, fine: DataFrame, keys: list[str], scale: str = "score") -> DataFrame:
    """The coarse map with each cell raised to the greatest fine score that falls in it (fine rows carry the coarse row and col)."""
    f = fine.groupBy(*keys, "row", "col").agg(F.max(scale).alias("_f"))
    return coarse.join(f, [*keys, "row", "col"], "left").withColumn("score", F.greatest("score", F.coalesce("_f", F.col("score")))).drop("_f")


def project_cells(cells: DataFrame, keys: list[str], crop_grid: int, grid: int, size: int) -> DataFrame:
    """keys, row, col of the image's grid cells below the centres of a crop's cells (crop box px0, py0, px1, py1 in pixels)."""
    to = lambda k, a, b: F.least(F.floor((F.col(a) + (F.col(k) + 0.5) * (F.col(b) - F.col(a)) / crop_grid) * grid / size), F.lit(grid - 1)).cast("int")
    return cells.select(*keys, to("row", "py0", "py1").alias("row"), to("col", "px0", "px1").alias("col")).distinct()


def splat_bilinear(patches: DataFrame, keys: list[str], blend: str = "hard") -> DataFrame:
    """keys, row, col, embedding: tile patches at (y, x) spread over their 4 cells; blended by 'hard', 'linear' or 'gaussian' of the share to the tile's edge (edge, 0..1)."""
    weight = {"hard": F.lit(1.0), "linear": F.greatest(F.col("edge"), F.lit(1e-6)), "gaussian": F.exp(-((1 - F.col("edge")) ** 2) / 0.5)}[blend]
    y, x = F.floor("y"), F.floor("x")
    fy, fx = F.col("y") - y, F.col("x") - x
    corner = lambda dy, dx, wy, wx: F.struct((y + dy).cast("int").alias("row"), (x + dx).cast("int").alias("col"), (wy * wx * weight).alias("w"))
    corners = F.array(corner(0, 0, 1 - fy, 1 - fx), corner(0, 1, 1 - fy, fx), corner(1, 0, fy, 1 - fx), corner(1, 1, fy, fx))
    rows = patches.select(*keys, "embedding", F.explode(corners).alias("_c")).select(*keys, "embedding", "_c.*")
    return weighted_vector_mean(rows, [*keys, "row", "col"], "w")


def sample_bilinear(points: DataFrame, cells: DataFrame, image: list[str], grid: int, size: int) -> DataFrame:
    """image, point_id, embedding: the bilinear, normalised vector at pixel points (x, y), clamped at the border."""
    at = lambda v: F.greatest(F.least(F.col(v) * grid / size - 0.5, F.lit(grid - 1.0)), F.lit(0.0))
    rows = points.withColumns({"_x": at("x"), "_y": at("y")})
    x0, y0 = F.floor("_x"), F.floor("_y")
    fx, fy = F.col("_x") - x0, F.col("_y") - y0
    top = F.lit(grid - 1)
    corner = lambda dy, dx, w: F.struct(F.least(y0 + dy, top).cast("int").alias("row"), F.least(x0 + dx, top).cast("int").alias("col"), w.alias("w"))
    rows = rows.select(*image, "point_id", F.explode(F.array(corner(0, 0, (1 - fy) * (1 - fx)), corner(0, 1, (1 - fy) * fx), corner(1, 0, fy * (1 - fx)), corner(1, 1, fy * fx))).alias("_c")).select(*image, "point_id", "_c.*")
    return weighted_vector_mean(rows.join(cells, [*image, "row", "col"]), [*image, "point_id"], "w")


def pooled(cells: DataFrame, keys: list[str], n: int) -> DataFrame:
    """keys, row, col, embedding: normalised means of n x n blocks."""
    return vector_mean(cells.select(*keys, F.floor(F.col("row") / n).cast("int").alias("row"), F.floor(F.col("col") / n).cast("int").alias("col"), "embedding"), [*keys, "row", "col"])


def on_grids(maps: DataFrame, keys: list[str], f, height: int, width: int) -> DataFrame:
    """Apply a numpy function to each map as an (H, W) array of scores, 0 where it has no row; keys, row, col, score of the results."""

    def run(t: pa.Table) -> pa.Table:
        g = np.zeros((height, width))
        g[t.column("row").to_numpy(), t.column("col").to_numpy()] = t.column("score").to_numpy()
        out = f(g)
        r, c = np.indices(out.shape)
        return pa.table({**{k: pa.chunked_array([t.column(k).combine_chunks().take(pa.array(np.zeros(out.size, int)))]) for k in keys}, "row": pa.array(r.ravel(), pa.int32()), "col": pa.array(c.ravel(), pa.int32()), "score": pa.array(out.ravel())})

    kinds = dict(maps.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", row int, col int, score double"
    return maps.select(*keys, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("score").cast("double").alias("score")).groupBy(*keys).applyInArrow(run, schema)


def upsample_map(maps: DataFrame, keys: list[str], height: int, width: int, to_height: int, to_width: int, how: str = "bilinear") -> DataFrame:
    f = blocks.resize_bilinear if how == "bilinear" else blocks.resize_nearest
    return on_grids(maps, keys, lambda g: f(g, to_height, to_width), height, width)


def box_smooth_vectors(patches: DataFrame, keys: list[str], size: int = 3) -> DataFrame:
    """keys, row, col, embedding: means over the in-bounds part of a size x size box of each image's grid; cells without a row do not count."""

    def run(t: pa.Table) -> pa.Table:
        r, c = t.column("row").to_numpy(), t.column("col").to_numpy()
        v = np.asarray(t.column("embedding").to_pylist(), float)
        g = np.zeros((r.max() + 1, c.max() + 1, v.shape[1]))
        there = np.zeros((*g.shape[:2], 1))
        g[r, c], there[r, c] = v, 1
        out = blocks.box_smooth(g, size)[r, c]
        if not there.all():
            out = out / blocks.box_smooth(there, size)[r, c]
        return pa.table({**{k: t.column(k) for k in keys}, "row": t.column("row"), "col": t.column("col"), "embedding": pa.array(out.tolist(), pa.list_(pa.float64()))})

    kinds = dict(patches.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", row int, col int, embedding array<double>"
    return patches.select(*keys, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "embedding").groupBy(*keys).applyInArrow(run, schema)
