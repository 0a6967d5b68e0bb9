"""Clusters of cells and tokens, and greedy selection. Each group is one image's grid or mask set, so it is bounded."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import PowerIterationClustering
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import blocks
from ..functions.geometry import apply_homography
from ..functions.vectors import cosine, dot, unit, vector_mean
from .scoremaps import sample_bilinear


def _labelled(cells: DataFrame, keys: list[str], label, value: str = "score") -> DataFrame:
    kinds = dict(cells.dtypes)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("row", "ascending"), ("col", "ascending")])
        at = np.stack((t.column("row").to_numpy(), t.column("col").to_numpy()), 1)
        return t.append_column("cluster_id", pa.array(label(at), pa.int64()))

    rows = cells.select(*keys, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), value)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + f", row int, col int, {value} {kinds[value]}, cluster_id long"
    return rows.groupBy(*keys).applyInArrow(run, schema)


def connected_components(cells: DataFrame, keys: list[str], diagonal: bool = True) -> DataFrame:
    """``cells`` (keys, row, col, score) with cluster_id: 8- or 4-connected blobs, numbered by first cell."""
    return _labelled(cells, keys, lambda at: blocks.link_cells(at, 1.5 if diagonal else 1.0))


def grid_dbscan(cells: DataFrame, keys: list[str], eps: float, min_samples: int) -> DataFrame:
    """``cells`` with cluster_id by DBSCAN on cell distance; noise is dropped."""
    return _labelled(cells, keys, lambda at: blocks.dbscan_cells(at, eps, min_samples)).where("cluster_id >= 0")


def cluster_table(cells: DataFrame, keys: list[str], least: int = 1, most: int | None = None) -> DataFrame:
    """keys, cluster_id, score (the greatest), size of clusters within the size bounds."""
    out = cells.groupBy(*keys, "cluster_id").agg(F.max("score").alias("score"), F.count("*").alias("size")).where(F.col("size") >= least)
    return out if most is None else out.where(F.col("size") <= most)


def region_grow(maps: DataFrame, peaks: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """keys, peak_row, peak_col, row, col: the 4-connected region with scores of at least ``threshold`` around each peak."""
    blobs = connected_components(maps.where(F.col("score") >= threshold), keys, diagonal=False)
    seed = peaks.select(*keys, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")).join(blobs, [*keys, "row", "col"]).select(*keys, "cluster_id", F.col("row").alias("peak_row"), F.col("col").alias("peak_col"))
    return seed.join(blobs, [*keys, "cluster_id"]).select(*keys, "peak_row", "peak_col", "row", "col")


def greedy_nms(masks: DataFrame, pairs: DataFrame, keys: list[str], limit: float, strict: bool = True, mask: str = "mask_id") -> DataFrame:
    """keys, mask of the masks kept in order of score: with ``strict`` those of IoU < limit to all kept ones, else <= limit.

    ``pairs`` has a (smaller id), b and iou of overlapping masks. Equal scores go by id.
    """
    return _greedy(masks, pairs, keys, mask, lambda ids, iou: blocks.greedy_keep(iou, ids, limit, strict))


def merge_overlapping(sizes: DataFrame, pairs: DataFrame, keys: list[str], mask: str = "mask_id") -> DataFrame:
    """keys, mask of the largest masks that share no cell with a larger kept one; ``sizes`` has the size as score."""
    return _greedy(sizes, pairs, keys, mask, lambda ids, iou: blocks.greedy_keep(iou, ids, 0.0, False))


def _greedy(masks: DataFrame, pairs: DataFrame, keys: list[str], mask: str, keep) -> DataFrame:
    kinds = dict(masks.dtypes)

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        x = x.sort_by([("score", "descending"), (mask, "ascending")])
        iou = {(a, b): v for a, b, v in zip(y.column("_a").to_pylist(), y.column("_b").to_pylist(), y.column("_iou").to_pylist(), strict=True)}
        ids = x.column(mask).to_pylist()
        kept = set(keep(ids, iou))
        return x.filter(pa.array([i in kept for i in ids], pa.bool_())).select([*keys, mask])

    left = masks.select(*keys, mask, F.col("score").cast("double").alias("score")).groupBy(*keys)
    right = pairs.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("iou").cast("double").alias("_iou")).groupBy(*[f"_{k}" for k in keys])
    return left.cogroup(right).applyInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in (*keys, mask)))


def greedy_match(predicted: DataFrame, truth: DataFrame, pairs: DataFrame, keys: list[str], accept: float) -> DataFrame:
    """keys, pred_id, gt_id, iou: predictions by score take their best free truth, if its IoU reaches ``accept``."""
    kinds = dict(predicted.dtypes)
    packed = pairs.groupBy(*keys).agg(F.collect_list(F.struct("pred_id", "gt_id", "iou")).alias("pairs"))
    p = predicted.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("pred_id").alias("i")))).alias("pred"))
    t = truth.groupBy(*keys).agg(F.array_sort(F.collect_list("gt_id")).alias("gt"))
    rows = p.join(t, keys).join(packed, keys)

    def run(batches):
        for batch in batches:
            cols = batch.to_pydict()
            out = []
            for i in range(batch.num_rows):
                iou = {(x["pred_id"], x["gt_id"]): x["iou"] for x in cols["pairs"][i]}
                for a, b, v in blocks.greedy_match([x["i"] for x in cols["pred"][i]], cols["gt"][i], iou, accept):
                    out.append((*[cols[k][i] for k in keys], a, b, v))
            names = [*keys, "pred_id", "gt_id", "iou"]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=pa.schema([*[batch.schema.field(k) for k in keys], ("pred_id", pa.int64()), ("gt_id", pa.int64()), ("iou", pa.float64())]))

    return rows.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", pred_id long, gt_id long, iou double")


def cluster_reject(cells: DataFrame, tokens: DataFrame, prototype: DataFrame, keys: list[str]) -> DataFrame:
    """keys, cluster_id, score: cosine of each cluster's mean token to its instance prototype (keys, embedding)."""
    mean = vector_mean(cells.join(tokens, [*keys, "row", "col"]), [*keys, "cluster_id"])
    p = prototype.select(*[c for c in prototype.columns if c != "embedding"], F.col("embedding").alias("_p"))
    on = [k for k in keys if k in p.columns]
    rows = mean.join(p, on) if on else mean.join(p, how="cross")
    return rows.select(*keys, "cluster_id", cosine("embedding", "_p").alias("score"))


def reject_cutoff(scored: DataFrame, keys: list[str], good: str = "good") -> DataFrame:
    """keys, cutoff from known clusters: min good - 0.2 |min good|, raised above the best bad + 0.001; without good ones min - 0.001."""
    g, b = F.when(F.col(good), F.col("score")), F.when(~F.col(good), F.col("score"))
    agg = scored.groupBy(*keys).agg(F.min(g).alias("g"), F.max(b).alias("b"), F.min("score").alias("m"))
    base = F.col("g") - 0.2 * F.abs("g")
    cut = F.when(F.col("g").isNull(), F.col("m") - 1e-3).otherwise(F.greatest(base, F.coalesce(F.col("b") + 1e-3, base)))
    return agg.select(*keys, F.coalesce(cut, F.lit(float("-inf"))).alias("cutoff"))


def cluster_tokens(tokens: DataFrame, keys: list[str], method: str, **options) -> DataFrame:
    """keys, row, col, cluster of each image's tokens: 'dbscan' (eps on cosine distance, min_samples), 'single', 'average', 'complete' linkage (threshold, or k clusters), or 'spectral' (k clusters in a graph of neighbours). -1 is noise."""
    kinds = dict(tokens.dtypes)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("row", "ascending"), ("col", "ascending")])
        x = blocks.unit_rows(np.asarray(t.column("embedding").to_pylist(), float))
        if method == "spectral":
            label = blocks.spectral_labels(x, options["k"], options.get("neighbours", 10))
        elif method == "dbscan":
            label = _dbscan(np.clip(1 - x @ x.T, 0, 2), options["eps"], options.get("min_samples", 3))
        else:
            label = blocks.linkage_labels(np.clip(1 - x @ x.T, 0, 2), method, options.get("threshold"), options.get("k"))
        return t.select([*keys, "row", "col"]).append_column("cluster", pa.array(label, pa.int64()))

    return tokens.select(*keys, "row", "col", "embedding").groupBy(*keys).applyInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in (*keys, "row", "col")) + ", cluster long")


def _dbscan(d: np.ndarray, eps: float, min_samples: int) -> np.ndarray:
    label, near, k = np.full(len(d), -1), d <= eps, 0
    core = near.sum(1) >= min_samples
    for i in np.flatnonzero(core):
        if label[i] >= 0:
            continue
        label[i], todo = k, [i]
        while todo:
            j = todo.pop()
            if core[j]:
                for m in np.flatnonzero(near[j] & (label < 0)):
                    label[m] = k
                    todo.append(m)
        k += 1
    return label


def spectral_tokens(similarities: DataFrame, k: int, rounds: int = 20) -> DataFrame:
    """id, cluster by power iteration clustering of (src, dst, weight) rows with positive weights."""
    return PowerIterationClustering(k=k, maxIter=rounds, weightCol="weight").assignClusters(similarities.where("weight > 0"))


def cluster_counts(labels: DataFrame, keys: list[str]) -> DataFrame:
    return labels.groupBy(*keys).agg(F.countDistinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("clusters"), F.count(F.when(F.col("cluster") < 0, 1)).alias("noise"))


def cycle_consistency(home: DataFrame, views: DataFrame, cells: DataFrame, image: list[str], share: float, self_limit: float, pixels: float, patch: int, grid: int) -> DataFrame:
    """image, a_id, share, self_similarity, kept of each patch of ``home`` (image, a_id, row, col, embedding).

    ``views`` has image, view and m, the matrix (9 values) that maps the image's pixels to the view's; ``cells`` image,
    view, row, col, embedding. A patch's centre is warped into each view and the view's vector there (bilinear) looks
    for its nearest patch at home, the first of equals. share is the part of the image's views where the centre falls
    inside and that patch is nearer than ``pixels``. Kept are patches over ``share`` whose cosine to the mean of the unit
    vectors (not normalised) is below ``self_limit``; in an image without any, the max(20, n // 10) of greatest share.
    """
    size = grid * patch
    centre = lambda c: (F.col(c) + 0.5) * patch
    own = unit(home.select(*image, "a_id", "row", "col", F.col("embedding").cast("array<double>").alias("embedding")), "embedding")
    points = own.drop("embedding").join(views.select(*image, "view", "m"), image).withColumns({"_x": centre("col"), "_y": centre("row")})
    warped = apply_homography(points, "m", "_x", "_y").where((F.col("px") >= 0) & (F.col("px") < size) & (F.col("py") >= 0) & (F.col("py") < size))
    sampled = sample_bilinear(warped.select(*image, "view", F.col("a_id").alias("point_id"), F.col("px").alias("x"), F.col("py").alias("y")), cells, [*image, "view"], grid, size)
    kinds = dict(own.dtypes)

    def run(points: pa.Table, patches: pa.Table) -> pa.Table:
        patches = patches.sort_by("a_id")
        x = lambda t: np.array(t.column("embedding").to_pylist()).reshape(t.num_rows, -1)
        at = (x(points) @ x(patches).T).argmax(1) if points.num_rows and patches.num_rows else np.zeros(0, np.int64)
        found, points = patches.take(pa.array(at)), points.slice(0, len(at))
        return pa.table({**{k: points.column(k) for k in image}, "view": points.column("view"), "a_id": points.column("point_id"), "_r": found.column("row"), "_c": found.column("col")})

    schema = ", ".join(f"{k} {kinds[k]}" for k in image) + f", view {dict(views.dtypes)['view']}, a_id {kinds['a_id']}, _r {kinds['row']}, _c {kinds['col']}"
    # one image's patches and their samples: a bounded group
    other = own.select(*[F.col(k).alias(f"_{k}") for k in image], "a_id", "row", "col", "embedding")
    back = sampled.groupBy(*image).cogroup(other.groupBy(*[f"_{k}" for k in image])).applyInArrow(run, schema)
    d = F.sqrt((F.col("_r") - F.col("row")) ** 2 + (F.col("_c") - F.col("col")) ** 2) * patch
    hits = back.join(own.select(*image, "a_id", "row", "col"), [*image, "a_id"]).where(d < pixels).groupBy(*image, "a_id").agg(F.count("*").alias("_hits"))
    known = views.groupBy(*image).agg(F.count("*").alias("_views"))
    mean = vector_mean(own, image, normalise=False).withColumnRenamed("embedding", "_m")
    rows = own.join(known, image).join(mean, image).select(*image, "a_id", "_views", dot("embedding", "_m").alias("self_similarity"))
    rows = rows.join(hits, [*image, "a_id"], "left").withColumn("share", F.coalesce("_hits", F.lit(0)) / F.col("_views"))
    rows = rows.withColumn("_ok", (F.col("share") > share) & (F.col("self_similarity") < self_limit))
    all_of = W.partitionBy(*image)
    most = F.row_number().over(all_of.orderBy(F.desc("share"), "a_id")) <= F.greatest(F.lit(20), F.floor(F.count("*").over(all_of) / 10))
    kept = F.when(F.max("_ok").over(all_of), F.col("_ok")).otherwise(most)
    return rows.select(*image, "a_id", "share", "self_similarity", kept.alias("kept"))


def cells_per_group(cells: DataFrame, keys: list[str]) -> DataFrame:
    return cells.withColumn("n", F.count("*").over(W.partitionBy(*keys)))
