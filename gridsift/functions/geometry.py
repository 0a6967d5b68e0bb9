"""Grid and pixel geometry as column arithmetic. Grids are (row, col); points and boxes in pixels are (x, y)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def patch_centre(index, patch_size) -> Column:
    return (_c(index) * _c(patch_size) + F.floor(_c(patch_size) / 2)).cast("int")


def pixel_to_patch(v, original, image_size, patch_size, n) -> Column:
    """The patch row or column of a pixel coordinate of the original image, at most n - 1."""
    scaled = (_c(v) * _c(image_size) / _c(original)).cast("long")
    return F.least(F.floor(scaled / _c(patch_size)), _c(n) - 1).cast("int")


def patch_to_pixel(index, original, n) -> Column:
    """The pixel of a patch's centre, cut to an integer."""
    return ((_c(index) + 0.5) * _c(original) / _c(n)).cast("int")


def patch_to_point(index, original, n) -> Column:
    return (_c(index) + 0.5) * (_c(original) / _c(n))


def coordinate_grid(df: DataFrame, height, width) -> DataFrame:
    """``df`` with a row for each cell (row, col) of its grid."""
    rows = df.withColumn("row", F.explode(F.sequence(F.lit(0), (_c(height) - 1).cast("int"))))
    return rows.withColumn("col", F.explode(F.sequence(F.lit(0), (_c(width) - 1).cast("int"))))


def scale_crop_boxes(df: DataFrame, pad: float, height="height", width="width") -> DataFrame:
    """A row per scale (close, mid, global) with crop box x0, y0, x1, y1 for rows with box r0, r1, c0, c1 (r1, c1 exclusive).

    close is the box padded by a share of its extent and clipped; mid lies half way to the whole image, edge by edge.
    """
    ph, pw = ((_c("r1") - _c("r0")) * pad).cast("int"), ((_c("c1") - _c("c0")) * pad).cast("int")
    close = [F.greatest(_c("c0") - pw, F.lit(0)), F.greatest(_c("r0") - ph, F.lit(0)), F.least(_c("c1") + pw, _c(width)), F.least(_c("r1") + ph, _c(height))]
    full = [F.lit(0), F.lit(0), _c(width), _c(height)]
    mid = [F.floor((a + b) / 2) for a, b in zip(close, full, strict=True)]
    box = lambda name, v: F.struct(F.lit(name).alias("scale"), *[x.cast("int").alias(k) for k, x in zip(("x0", "y0", "x1", "y1"), v, strict=True)])
    return df.withColumn("_b", F.explode(F.array(box("close", close), box("mid", mid), box("global", full)))).select(*df.columns, "_b.*")


def scale_crop_series(df: DataFrame, n: int, least: int = 2) -> DataFrame:
    """n boxes from the whole image to the box (x0, y0, x1, y1) in equal steps, half-even rounded; one below ``least`` pixels fails."""
    t = F.col("step") / F.lit(max(n - 1, 1))
    rows = df.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    to = lambda full, box: F.bround(_c(full) + (_c(box) - _c(full)) * t).cast("int")
    cut = {"bx0": to(F.lit(0), "x0"), "by0": to(F.lit(0), "y0"), "bx1": to("width", "x1"), "by1": to("height", "y1")}
    rows = rows.withColumns(cut)
    small = (F.col("bx1") - F.col("bx0") < least) | (F.col("by1") - F.col("by0") < least)
    return rows.withColumn("bx0", F.when(small, F.raise_error("a crop is too small").cast("int")).otherwise(F.col("bx0")))


def aspect_ratio_boxes(df: DataFrame, ratios: list[float]) -> DataFrame:
    """For each w:h ratio, the box (x0, y0, x1, y1) of the same centre and area, clipped to the image."""
    rows = df.withColumn("ratio", F.explode(F.array(*map(F.lit, map(float, ratios)))))
    area = (_c("x1") - _c("x0")) * (_c("y1") - _c("y0"))
    w, h = F.sqrt(area * F.col("ratio")), F.sqrt(area / F.col("ratio"))
    cx, cy = (_c("x0") + _c("x1")) / 2, (_c("y0") + _c("y1")) / 2
    clip = lambda v, top: F.least(F.greatest(F.bround(v), F.lit(0)), _c(top)).cast("int")
    return rows.withColumns({"ax0": clip(cx - w / 2, "width"), "ay0": clip(cy - h / 2, "height"), "ax1": clip(cx + w / 2, "width"), "ay1": clip(cy + h / 2, "height")})


def pad_and_floor_box(df: DataFrame, pad: float, min_side: int, grid_h="grid_h", grid_w="grid_w", height="height", width="width") -> DataFrame:
    """Grid boxes (r0, r1, c0, c1, ends exclusive) in native pixels, padded, grown to a least side, clipped; sides under 2 px are dropped."""
    sx, sy = _c(width) / _c(grid_w), _c(height) / _c(grid_h)
    x0, x1, y0, y1 = _c("c0") * sx, _c("c1") * sx, _c("r0") * sy, _c("r1") * sy
    w, h = (x1 - x0) * (1 + 2 * pad), (y1 - y0) * (1 + 2 * pad)
    w, h = F.greatest(w, F.lit(float(min_side))), F.greatest(h, F.lit(float(min_side)))
    cx, cy = (x0 + x1) / 2, (y0 + y1) / 2
    clip = lambda v, top: F.least(F.greatest(v.cast("int"), F.lit(0)), _c(top)).cast("int")
    out = df.withColumns({"px0": clip(cx - w / 2, width), "py0": clip(cy - h / 2, height), "px1": clip(cx + w / 2, width), "py1": clip(cy + h / 2, height)})
    return out.where((F.col("px1") - F.col("px0") >= 2) & (F.col("py1") - F.col("py0") >= 2))


def density_crop_box(df: DataFrame, keys: list[str], density: str, grid_h: int, grid_w: int, height: int, width: int, pad: int = 0) -> DataFrame:
    """Pixel box around the cells with positive density, padded by cells and clipped; without such cells, the whole image."""
    on = F.col(density) > 0
    r = lambda f, k: f(F.when(on, F.col(k)))
    box = df.groupBy(*keys).agg(r(F.min, "row").alias("a"), r(F.max, "row").alias("b"), r(F.min, "col").alias("c"), r(F.max, "col").alias("d"))
    sy, sx = height / grid_h, width / grid_w
    edge = lambda v, s, top, other: F.coalesce(F.greatest(F.least((v * s).cast("int"), F.lit(top)), F.lit(0)), F.lit(other))
    return box.select(*keys, edge(F.col("c") - pad, sx, width, 0).alias("x0"), edge(F.col("a") - pad, sy, height, 0).alias("y0"), edge(F.col("d") + 1 + pad, sx, width, width).alias("x1"), edge(F.col("b") + 1 + pad, sy, height, height).alias("y1"))


def expand_tiles(df: DataFrame, n: int, overlap: float, height="height", width="width") -> DataFrame:
    """The n x n tile rectangles of an image, each grown by a share of its size on inner sides, clamped."""
    rows = df.withColumn("ty", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("tx", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    w, h = _c(width) / n, _c(height) / n
    at = lambda k, s, grow, top: F.least(F.greatest((_c(k) * s + grow).cast("int"), F.lit(0)), _c(top)).cast("int")
    return rows.withColumns({"x0": at("tx", w, -w * overlap, width), "x1": at("tx", w, w * (1 + overlap), width), "y0": at("ty", h, -h * overlap, height), "y1": at("ty", h, h * (1 + overlap), height)})


def receptive_field_range(df: DataFrame, n: int, overlaps: list[float], patches: int) -> DataFrame:
    """For each overlap, the least and greatest tile side in pixels and in pixels a patch."""
    rows = df.withColumn("overlap", F.explode(F.array(*map(F.lit, map(float, overlaps)))))
    parts = [expand_tiles(rows.where(F.col("overlap") == o), n, o) for o in overlaps]
    tiles = parts[0]
    for p in parts[1:]:
        tiles = tiles.unionByName(p)
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    least = F.least(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return tiles.groupBy("overlap").agg(F.min(least).alias("min_px"), F.max(side).alias("max_px"), (F.min(least) / patches).alias("min_px_per_patch"), (F.max(side) / patches).alias("max_px_per_patch"))


def apply_homography(df: DataFrame, matrix: str, x="x", y="y") -> DataFrame:
    """Points (px, py) under a 3x3 matrix (9 values, row by row) or a 2x3 affine one (6 values)."""
    m = lambda i: F.get(matrix, F.lit(i)).cast("double")
    w = F.when(F.size(matrix) == 9, m(6) * _c(x) + m(7) * _c(y) + m(8)).otherwise(F.lit(1.0))
    return df.withColumns({"px": (m(0) * _c(x) + m(1) * _c(y) + m(2)) / w, "py": (m(3) * _c(x) + m(4) * _c(y) + m(5)) / w})


def point_error(x, y, tx, ty) -> Column:
    return F.sqrt((_c(x) - _c(tx)) ** 2 + (_c(y) - _c(ty)) ** 2)


def tile_owner(row, col, tile_h, tile_w, n) -> Column:
    """The tile that a patch of a stitched grid belongs to."""
    return (F.floor(_c(row) / _c(tile_h)) * _c(n) + F.floor(_c(col) / _c(tile_w))).cast("int")


def severity_fraction(value: str, keys: list[str], order: str) -> Column:
    """(v - first) / (last - first) within a family; 0 where they are equal."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    a, b = F.first(value).over(w), F.last(value).over(w)
    return F.when(a == b, F.lit(0.0)).otherwise((F.col(value) - a) / (b - a))
