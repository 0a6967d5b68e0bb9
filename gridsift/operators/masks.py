"""Masks as sparse cells: overlaps, grids, boxes, and per-mask numpy steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import blocks
from ..functions.vectors import EPSILON, cosine, vector_mean


def mask_iou(a: DataFrame, b: DataFrame, image: list[str], a_id: str, b_id: str, nms: bool = False) -> DataFrame:
    """image, a_id, b_id, inter, iou of the mask pairs of an image that share a cell; cells are image, id, row, col.

    iou is inter / (union + 1e-8), or with ``nms`` inter / union. Pairs without a common cell have IoU 0 and no row.
    """
    size = lambda d, k, n: d.groupBy(*image, k).agg(F.count("*").alias(n))
    both = a.join(b, [*image, "row", "col"]).groupBy(*image, a_id, b_id).agg(F.count("*").alias("inter"))
    rows = both.join(size(a, a_id, "_na"), [*image, a_id]).join(size(b, b_id, "_nb"), [*image, b_id])
    union = F.col("_na") + F.col("_nb") - F.col("inter")
    return rows.select(*image, a_id, b_id, "inter", (F.col("inter") / (union if nms else union + EPSILON)).alias("iou"))


def rle_cells(df: DataFrame, keys: list[str], rle: str = "rle", width: str = "width") -> DataFrame:
    """keys, row, col of the true cells of run-length masks, in time linear in runs and pixels; null or empty runs have none."""
    kinds = dict(df.dtypes)
    k = len(keys)

    def run(batches):
        for batch in batches:
            for i, (runs, wide) in enumerate(zip(batch.column(k).to_pylist(), batch.column(k + 1).to_pylist(), strict=True)):
                at = np.flatnonzero(np.repeat(np.arange(len(runs)) % 2 == 1, runs)) if runs else np.zeros(0, np.int64)
                if len(at):
                    own = pa.array(np.full(len(at), i))
                    yield pa.RecordBatch.from_arrays([*(batch.column(j).take(own) for j in range(k)), pa.array(at // wide, pa.int32()), pa.array(at % wide, pa.int32())], [*keys, "row", "col"])

    return df.select(*keys, rle, width).mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in keys) + ", row int, col int")


def min_area_filter(cells: DataFrame, keys: list[str], area: int, share: float) -> DataFrame:
    """Masks of at least int(area * share) cells."""
    big = cells.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= int(area * share)).select(*keys)
    return cells.join(big, keys, "left_semi")


def class_filter(cells: DataFrame, classes: list[str] | None = None) -> DataFrame:
    return cells if classes is None else cells.where(F.col("class").isin(classes) if classes else F.lit(False))


def union_mask(cells: DataFrame, image: list[str]) -> DataFrame:
    return cells.select(*image, "row", "col").distinct()


def mask_bbox(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, x, y, w, h (pixels covered), and the half-open box r0, r1, c0, c1."""
    box = cells.groupBy(*keys).agg(F.min("row").alias("r0"), (F.max("row") + 1).alias("r1"), F.min("col").alias("c0"), (F.max("col") + 1).alias("c1"))
    return box.select(*keys, F.col("c0").alias("x"), F.col("r0").alias("y"), (F.col("c1") - F.col("c0")).alias("w"), (F.col("r1") - F.col("r0")).alias("h"), "r0", "r1", "c0", "c1")


def mask_to_grid(pixels: DataFrame, keys: list[str], patch: int, how: str = "fraction", value: str = "value", threshold: float = 0.3) -> DataFrame:
    """keys, row, col, value of grid cells from pixel rows (row, col, value).

    'fraction': 1 where at least ``threshold`` of the cell's pixels are not 0; 'center': the centre pixel's value;
    'majority': the commonest value, the least of equals. Another name is an error.
    """
    cell = [F.floor(F.col("row") / patch).cast("int").alias("row"), F.floor(F.col("col") / patch).cast("int").alias("col")]
    rows = pixels.select(*keys, *cell, F.col("row").alias("_y"), F.col("col").alias("_x"), F.col(value).alias("value"))
    if how == "fraction":
        return rows.groupBy(*keys, "row", "col").agg((F.avg((F.col("value") != 0).cast("double")) >= threshold).cast("int").alias("value"))
    if how == "center":
        return rows.where((F.col("_y") % patch == patch // 2) & (F.col("_x") % patch == patch // 2)).select(*keys, "row", "col", "value")
    if how == "majority":
        n = rows.groupBy(*keys, "row", "col", "value").agg(F.count("*").alias("_n"))
        return n.groupBy(*keys, "row", "col").agg(F.min_by("value", F.struct((-F.col("_n")).alias("n"), "value")).alias("value"))
    raise ValueError(f"unknown reduction {how!r}")


def on_masks(df: DataFrame, keys: list[str], f, arguments: tuple = (), height: str = "height", width: str = "width", rle: str = "rle", inside: str | None = None) -> DataFrame:
    """Apply a numpy function to each run-length mask of ``df``; keys, height, width, rle of the results.

    ``inside`` names a column with the run lengths of the cells that an incomplete grid has: the function gets them as its last argument.
    """
    kept = [*keys, height, width, rle]

    def run(batches):
        for batch in batches:
            got, sizes = [], []
            for h, w, r, *i in zip(*(c.to_pylist() for c in batch.columns[len(keys) :]), strict=True):
                m, *own = (blocks.rle_decode((h, w), x) if x else np.zeros((h, w), bool) for x in (r, *i))
                m = f(m, *arguments, *own)
                got.append(blocks.rle_encode(m))
                sizes.append(m.shape)
            cols = [batch.column(i) for i in range(len(keys))] + [pa.array([s[0] for s in sizes], pa.int32()), pa.array([s[1] for s in sizes], pa.int32()), pa.array(got, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, kept)

    rows = df.select(*keys, F.col(height).cast("int").alias(height), F.col(width).cast("int").alias(width), F.col(rle).cast("array<int>").alias(rle))
    more = [] if inside is None else [F.col(inside).cast("array<int>").alias("_inside")]
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in rows.dtypes], *more).mapInArrow(run, rows.schema)


def morph_open(df: DataFrame, keys: list[str], k: int = 20, inside: str | None = None) -> DataFrame:
    """Openings; cells that are not ``inside`` (run lengths, see on_masks()) count as those beyond the edge."""
    return on_masks(df, keys, blocks.open_mask, (k,), inside=inside)


def morph_close(df: DataFrame, keys: list[str], times: int = 1, inside: str | None = None) -> DataFrame:
    return on_masks(df, keys, blocks.close_mask, (times,), inside=inside)


def mask_grid_share(df: DataFrame, keys: list[str], size: int, grid: int, threshold: float = 0.3) -> DataFrame:
    """Dense masks resized to size x size (nearest), then cells of a grid x grid mask with at least ``threshold`` true pixels."""
    return on_masks(df, keys, lambda m: blocks.mask_share(blocks.resize_nearest(m, size, size), grid, grid) >= threshold)


def instance_patch_sizes(grid_cells: DataFrame, keys: list[str]) -> DataFrame:
    return grid_cells.groupBy(*keys).agg(F.count("*").alias("size"))


def prefilter_candidates(cells: DataFrame, tokens: DataFrame, prototype: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """keys, score, box of proposals (cells) whose mean token's cosine to the one prototype is at least ``threshold``; empty ones go."""
    mean = vector_mean(cells.join(tokens, ["image_id", "row", "col"]), keys)
    scored = mean.join(prototype.select(F.col("embedding").alias("_p")), how="cross").select(*keys, cosine("embedding", "_p").alias("score")).where(F.col("score") >= threshold)
    return scored.join(mask_bbox(cells, keys).select(*keys, "x", "y", "w", "h"), keys)


def prompt_region(prompts: DataFrame, height: int, width: int, image: list[str] | None = None) -> DataFrame:
    """image, prompt_id, row, col covered by a prompt's boxes (kind 'box': x0, y0, x1, y1) or discs (kind 'disc': x0, y0, radius)."""
    top = F.when(F.col("kind") == "box", F.col("y0")).otherwise(F.col("y0") - F.col("radius"))
    low = F.when(F.col("kind") == "box", F.col("y1") - 1).otherwise(F.col("y0") + F.col("radius"))
    left = F.when(F.col("kind") == "box", F.col("x0")).otherwise(F.col("x0") - F.col("radius"))
    right = F.when(F.col("kind") == "box", F.col("x1") - 1).otherwise(F.col("x0") + F.col("radius"))
    span = lambda a, b, n: F.filter(F.sequence(F.greatest(F.ceil(a), F.lit(0)).cast("int"), F.greatest(F.least(F.floor(b), F.lit(n - 1)), F.lit(-1)).cast("int")), lambda x: (x >= F.greatest(F.ceil(a), F.lit(0))) & (x <= F.least(F.floor(b), F.lit(n - 1))))
    rows = prompts.withColumn("row", F.explode(span(top, low, height))).withColumn("col", F.explode(span(left, right, width)))
    inside = (F.col("kind") == "box") | ((F.col("row") - F.col("y0")) ** 2 + (F.col("col") - F.col("x0")) ** 2 <= F.col("radius") ** 2)
    return rows.where(inside).select(*(image or []), "prompt_id", "row", "col").distinct()


def best_mask_for_prompt(region: DataFrame, prompts: DataFrame, cells: DataFrame, masks: DataFrame, image: list[str] | None = None) -> DataFrame:
    """image, prompt_id, mask_id: the mask with most cells in the prompt's region, the first of equals (so the image's first for an empty region).

    Prompts meet only masks that share a cell with their region. Images without masks give no rows.
    """
    image = image or []
    hit = region.join(cells, [*image, "row", "col"]).groupBy(*image, "prompt_id", "mask_id").agg(F.count("*").alias("_n"))
    best = hit.groupBy(*image, "prompt_id").agg(F.min_by("mask_id", F.struct((-F.col("_n")).alias("n"), "mask_id")).alias("_best"))
    first = masks.groupBy(*image).agg(F.min("mask_id").alias("_first"))
    rows = prompts.select(*image, "prompt_id").distinct()
    rows = (rows.join(first, image) if image else rows.join(F.broadcast(first), how="cross")).join(best, [*image, "prompt_id"], "left")
    return rows.select(*image, "prompt_id", F.coalesce("_best", "_first").alias("mask_id")).where("mask_id IS NOT NULL")


def neighbour_similarity(cells: DataFrame, keys: list[str], axis: str, similarity) -> DataFrame:
    """keys, row, col, similarity of each cell's vector to the next one's along ``axis`` ('row' or 'col')."""
    other = "col" if axis == "row" else "row"
    nxt = F.lead("embedding").over(W.partitionBy(*keys, other).orderBy(axis))
    step = F.lead(axis).over(W.partitionBy(*keys, other).orderBy(axis))
    rows = cells.withColumn("_n", nxt).withColumn("_a", step).where(F.col("_a") == F.col(axis) + 1)
    return rows.select(*keys, "row", "col", similarity("embedding", "_n").alias("similarity"))


def weighted(c: str | Column, w: str | Column) -> Column:
    return F.sum(F.col(c) * F.col(w)) / F.sum(w)
