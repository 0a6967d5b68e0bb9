"""Detectors put together from the other operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import pad_and_floor_box, patch_to_pixel
from ..functions.vectors import cosine
from .clusters import cluster_reject, cluster_table, connected_components, merge_overlapping
from .masks import mask_bbox, mask_iou
from .prototypes import score_prototypes
from .scoremaps import density, peaks, roi_mask, splat_max


def density_detect(patches: DataFrame, prototypes: DataFrame, keys: list[str], threshold: float, kernel: int = 3, grid: int = 10, size: int = 100) -> DataFrame:
    """keys, x, y, score of density peaks: mean cosine to the prototypes above a threshold, at local maxima."""
    maps = score_prototypes(patches, prototypes, [*keys, "row", "col"], "mean").withColumn("score", density("score", threshold))
    top = peaks(maps, keys, kernel)
    return top.select(*keys, patch_to_pixel("col", F.lit(size), grid).alias("x"), patch_to_pixel("row", F.lit(size), grid).alias("y"), "score")


def detection_sweep(scored: DataFrame, keys: list[str], thresholds: list[float], kernel: int = 3) -> DataFrame:
    """keys, threshold, n_peaks, max_density for each threshold, in one pass: the threshold is part of every window's key."""
    rows = scored.withColumn("threshold", F.explode(F.array(*map(F.lit, map(float, thresholds)))))
    rows = rows.withColumn("score", F.greatest(F.col("score") - F.col("threshold"), F.lit(0.0)))
    top = peaks(rows, [*keys, "threshold"], kernel).groupBy(*keys, "threshold").agg(F.count("*").alias("n_peaks"))
    most = rows.groupBy(*keys, "threshold").agg(F.max("score").alias("max_density"))
    return most.join(top, [*keys, "threshold"], "left").withColumn("n_peaks", F.coalesce("n_peaks", F.lit(0).cast("long")))


def peak_self_similarity(top: DataFrame, patches: DataFrame, keys: list[str]) -> DataFrame:
    """keys, peak_row, peak_col, row, col, similarity of each peak's own token to every token of its image."""
    at = top.select(*keys, "row", "col").join(patches, [*keys, "row", "col"]).select(*keys, F.col("row").alias("peak_row"), F.col("col").alias("peak_col"), F.col("embedding").alias("_p"))
    return at.join(patches, keys).select(*keys, "peak_row", "peak_col", "row", "col", cosine("_p", "embedding").alias("similarity"))


def two_stage_boxes(maps: DataFrame, keys: list[str], roi: str, value: float | None, pad: float, min_side: int, grid: int, size: int, least: int = 1) -> DataFrame:
    """keys, cluster_id, px0, py0, px1, py1: padded pixel boxes of a coarse map's regions, for a second look at full scale."""
    blobs = connected_components(roi_mask(maps, keys, roi, value), keys)
    some = cluster_table(blobs, keys, least).select(*keys, "cluster_id")
    box = mask_bbox(blobs.join(some, [*keys, "cluster_id"], "left_semi"), [*keys, "cluster_id"])
    lit = lambda v: F.lit(v)
    return pad_and_floor_box(box, pad, min_side, lit(grid), lit(grid), lit(size), lit(size)).select(*keys, "cluster_id", "px0", "py0", "px1", "py1")


def two_stage_refine(maps: DataFrame, fine: DataFrame, keys: list[str], grid: int, size: int) -> DataFrame:
    """The coarse map raised by fine scores at crop cells (crop box px0.. and cell y, x in pixels): a second stage's projection."""
    to = lambda v: F.least(F.floor(F.col(v) * grid / size), F.lit(grid - 1)).cast("int")
    return splat_max(maps, fine.withColumns({"row": to("y"), "col": to("x")}), keys)


def two_stage_detect(maps: DataFrame, embed, prototypes: DataFrame, keys: list[str], roi: str, value: float | None, pad: float, min_side: int, grid: int, size: int, least: int = 1, how: str = "max") -> DataFrame:
    """The coarse maps raised by a second look at their regions.

    ``embed`` maps the pixel boxes of two_stage_boxes() to crop cells: keys, cluster_id, cell (a number in its crop),
    x, y (the cell's centre in pixels) and embedding. Cells are scored against ``prototypes`` and projected back.
    """
    cells = embed(two_stage_boxes(maps, keys, roi, value, pad, min_side, grid, size, least))
    fine = score_prototypes(cells, prototypes, [*keys, "cluster_id", "cell", "x", "y"], how)
    return two_stage_refine(maps, fine, keys, grid, size)


def two_stage_clusters(cells: DataFrame, prototype: DataFrame, keys: list[str], threshold: float, cutoff: float, grid: int, size: int) -> DataFrame:
    """keys, mask_id, row, col: crop cells above ``threshold`` clustered in each crop, rejected, projected and merged.

    ``cells`` has keys, cluster_id (the crop), row, col (in the crop's own grid), x, y (pixels), score and embedding.
    Clusters whose mean token's cosine to the one prototype is below ``cutoff`` go. The rest are masks on the image's
    grid; of those that share a cell, the largest stay (equal ones: the first).
    """
    tokens = cells.withColumnRenamed("cluster_id", "_crop")
    own = [*keys, "_crop"]
    blobs = connected_components(tokens.where(F.col("score") > threshold), own)
    good = cluster_reject(blobs, tokens.select(*own, "row", "col", "embedding"), prototype, own).where(F.col("score") >= cutoff).select(*own, "cluster_id")
    at = blobs.drop("score").join(good, [*own, "cluster_id"], "left_semi").join(tokens.select(*own, "row", "col", "x", "y"), [*own, "row", "col"])
    to = lambda v: F.least(F.floor(F.col(v) * grid / size), F.lit(grid - 1)).cast("int")
    number = F.dense_rank().over(W.partitionBy(*keys).orderBy("_crop", "cluster_id")) - 1  # one image's clusters
    found = at.select(*keys, number.cast("long").alias("mask_id"), to("y").alias("row"), to("x").alias("col")).distinct()
    sizes = found.groupBy(*keys, "mask_id").agg(F.count("*").alias("score"))
    other = found.withColumnRenamed("mask_id", "other_id")
    pairs = mask_iou(found, other, keys, "mask_id", "other_id").where("mask_id < other_id").withColumnsRenamed({"mask_id": "a", "other_id": "b"})
    return found.join(merge_overlapping(sizes, pairs, keys), [*keys, "mask_id"], "left_semi")
