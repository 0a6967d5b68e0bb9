"""Prototypes: mean vectors of labelled or masked patches, and scores against them."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import blocks
from ..functions.vectors import EPSILON, cosine, dot, unit, vector_mean


def label_prototypes(patches: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """label, embedding: the normalised mean of each label's raw vectors; labels without patches have none."""
    rows = patches.select(F.explode(F.array_distinct("labels")).alias("label"), "embedding")
    return vector_mean(rows if labels is None else rows.where(F.col("label").isin(labels)), ["label"])


def masked_prototype(patches: DataFrame, keys: list[str], mask: str) -> DataFrame:
    """Mean over masked cells of each group, or over all of them where none is masked."""
    sides = vector_mean(patches.withColumn("_masked", F.coalesce(F.col(mask), F.lit(False))), [*keys, "_masked"])
    return sides.groupBy(*keys).agg(F.max_by("embedding", "_masked").alias("embedding"))  # at most two rows a group


def prototype_of_prototypes(patches: DataFrame, instance: list[str], scale: str) -> DataFrame:
    """scale, embedding: means of per-instance prototypes for each scale, and over all scales as 'pooled'; renormalised."""
    each = vector_mean(patches, [*instance, scale])
    own = vector_mean(each, [scale]).withColumn(scale, F.col(scale).cast("string"))
    return own.unionByName(vector_mean(each.withColumn(scale, F.lit("pooled")), [scale]))


def fgbg_prototypes(cells: DataFrame, crop: list[str], instance: str = "instance", mask: str = "mask") -> DataFrame:
    """crop, instance, side, embedding. fg is an instance's masked mean; bg (null instance) the mean of cells outside every instance.

    ``cells`` has a row for each crop, cell and instance: vector and whether the instance covers the cell.
    """
    fg = vector_mean(cells.where(F.col(mask)), [*crop, instance]).withColumn("side", F.lit("fg"))
    free = cells.groupBy(*crop, "row", "col").agg(F.max(F.col(mask).cast("int")).alias("m"), F.first("embedding").alias("embedding")).where("m = 0")
    bg = vector_mean(free, crop).withColumn(instance, F.lit(None).cast(dict(cells.dtypes)[instance])).withColumn("side", F.lit("bg"))
    return fg.unionByName(bg)


def fgbg_banks(cells: DataFrame, mask: str = "mask") -> DataFrame:
    """Foreground and background rows in one bank, with is_fg."""
    fg = cells.where(F.col(mask)).withColumn("is_fg", F.lit(True))
    return fg.unionByName(cells.where(~F.col(mask)).withColumn("is_fg", F.lit(False)))


#: Bytes of prototypes, as doubles, that every task holds at once; more are met in several passes over the patches.
PROTOTYPE_BYTES = 64 << 20


def score_prototypes(patches: DataFrame, prototypes: DataFrame, keys: list[str], how: str = "max", group: list[str] | None = None) -> DataFrame:
    """keys, score: the greatest or mean cosine of each patch to the prototypes (of each ``group`` of them).

    ``keys`` tell patches apart. Prototypes are broadcast in blocks of a bounded size and met by a matrix product; patches
    are not shuffled unless there are several blocks, whose partial results are merged by ``keys``. A patch without a
    vector scores null; without prototypes there are no rows. Prototypes without a vector are left out.
    """
    if how not in ("max", "mean"):
        raise ValueError(f"unknown aggregation {how!r}")
    group = group or []
    known = prototypes.select(*group, F.col("embedding").cast("array<double>").alias("embedding")).where("embedding IS NOT NULL")
    size = known.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).head()
    kinds, own = dict(patches.dtypes), dict(prototypes.dtypes)
    if not size.n:
        return patches.select(*keys, *[F.lit(None).cast(own[g]).alias(g) for g in group], F.lit(0.0).alias("score")).limit(0)
    parts = -(-size.n * size.d * 8 // PROTOTYPE_BYTES)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *(f"`{g}` {own[g]}" for g in group), "s double", "n long"])
    rows = patches.select(*keys, F.col("embedding").cast("array<double>").alias("embedding"))
    found = [rows.mapInArrow(_block_scores(known if parts == 1 else known.where(F.pmod(F.xxhash64("embedding"), F.lit(parts)) == i), keys, group, how), schema) for i in range(parts)]
    seen = functools.reduce(DataFrame.unionByName, found)
    if parts > 1:
        seen = seen.groupBy(*keys, *group).agg((F.max("s") if how == "max" else F.sum("s")).alias("s"), F.sum("n").alias("n"))
    return seen.select(*keys, *group, F.col("s").alias("score") if how == "max" else (F.col("s") / F.col("n")).alias("score"))


def _block_scores(block: DataFrame, keys: list[str], group: list[str], how: str):
    """A function of Arrow batches (keys, embedding) to keys, group, s (greatest or summed cosine) and n for one bounded block."""
    got = block.toArrow()
    names = got.select(group).to_pylist() if group else [{}] * got.num_rows
    seen = {}
    of = np.array([seen.setdefault(tuple(r.values()), len(seen)) for r in names], int)
    order = np.argsort(of, kind="stable")
    y = blocks.matrix(got.column("embedding"))[order]
    starts = np.searchsorted(of[order], np.arange(len(seen)))
    first = pa.array(order[starts]) if len(seen) else pa.array([], pa.int64())
    values = [got.column(g).take(first).combine_chunks() for g in group]
    shared = block.sparkSession.sparkContext.broadcast((y, np.linalg.norm(y, axis=1), starts, np.bincount(of, minlength=len(seen)), values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, norms, starts, counts, values = shared.value
        g = len(starts)
        if not g:
            return
        for batch in batches:
            step = max(1, 4_000_000 // len(y))
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                column = part.column(len(keys))
                there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
                s = np.full((part.num_rows, g), np.nan)
                if len(there):
                    x = blocks.matrix(column.take(pa.array(there)))
                    cos = x @ y.T / (np.linalg.norm(x, axis=1)[:, None] * norms + EPSILON)
                    s[there] = (np.maximum if how == "max" else np.add).reduceat(cos, starts, axis=1)
                own = pa.array(np.repeat(np.arange(part.num_rows), g))
                tiled = pa.array(np.tile(np.arange(g), part.num_rows))
                flat = s.ravel()
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(own) for k in range(len(keys))), *(v.take(tiled) for v in values), pa.array(flat, mask=np.isnan(flat)), pa.array(np.tile(counts, part.num_rows))], [*keys, *group, "s", "n"])

    return run


def score_fgbg_mean(patches: DataFrame, prototypes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, score: cosine to the fg prototype less that to the bg one."""
    s = score_prototypes(patches, prototypes, keys, "mean", ["side"])
    return s.groupBy(*keys).agg(F.sum(F.when(F.col("side") == "fg", F.col("score")).otherwise(-F.col("score"))).alias("score"))


def ensemble_prototypes(prototypes: DataFrame, combos: DataFrame, mode: str) -> DataFrame:
    """combo, embedding (and scale, for 'max') of named sets of scales; a set with a missing scale gives none.

    ``combos`` has combo and scales (an array). 'max' keeps the rows, for scoring by maximum; 'mean' averages and renormalises.
    """
    rows = combos.select("combo", F.size("scales").alias("_n"), F.explode("scales").alias("scale")).join(prototypes, "scale")
    whole = rows.groupBy("combo").agg(F.countDistinct("scale").alias("_k"), F.first("_n").alias("_m")).where("_k = _m").select("combo")
    rows = rows.join(whole, "combo", "left_semi").drop("_n")
    if mode == "max":
        return rows.select("combo", "scale", "embedding")
    if mode == "mean":
        return vector_mean(rows, ["combo"])
    raise ValueError(f"unknown mode {mode!r}")


def cumulative_prototypes(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """For each row in ``order``, the normalised mean vector of its group up to it, as ``embedding``: running sums by dimension."""
    each = rows.select(*keys, order, F.posexplode("embedding").alias("_i", "_x")).where(F.col("_x").isNotNull())
    upto = W.partitionBy(*keys, "_i").orderBy(order)  # rows of equal order count together
    sums = each.select(*keys, order, "_i", F.sum("_x").over(upto).alias("_s")).dropDuplicates([*keys, order, "_i"])
    whole = sums.groupBy(*keys, order).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_s"))), lambda x: x["_s"]).alias("embedding"))
    return unit(whole, "embedding").select(*keys, order, "embedding")


def kmeans_cosine(df: DataFrame, k: int, rounds: int = 10, seed: int = 0) -> DataFrame:
    """``df`` with a cluster number by Spark's k-means on cosine distance."""
    rows = df.withColumn("_v", array_to_vector(F.col("embedding").cast("array<double>")))
    model = KMeans(k=k, maxIter=rounds, distanceMeasure="cosine", featuresCol="_v", predictionCol="cluster", seed=seed).fit(rows)
    return model.transform(rows).drop("_v")


def lloyd_cosine(df: DataFrame, start: DataFrame, key: list[str], rounds: int = 10) -> tuple[DataFrame, DataFrame]:
    """Spherical Lloyd steps from given centroids (k, embedding): assignments and centroids; an empty cluster keeps its centroid."""
    rows, centres = unit(df, "embedding"), unit(start.select("k", "embedding"), "embedding")
    for _ in range(rounds):
        one = F.broadcast(centres.agg(F.collect_list(F.struct("k", "embedding")).alias("_cs")))  # k vectors in one row
        near = F.array_min(F.transform("_cs", lambda c: F.struct((-dot("embedding", c["embedding"])).alias("s"), c["k"].alias("k"))))
        best = rows.select(*key, "embedding").join(one, how="cross").select(*key, near["k"].alias("k"))
        new = vector_mean(rows.join(best, key), ["k"]).withColumnRenamed("embedding", "_new")
        got = centres.join(new, "k", "left").select("k", F.coalesce("_new", "embedding").alias("embedding")).orderBy("k").collect()  # k rows
        centres = df.sparkSession.createDataFrame([(r.k, list(r.embedding)) for r in got], centres.schema)
    return best, centres


def exemplar_clusters(tokens: DataFrame, k: int, exemplar: str = "exemplar_id", pos: str = "pos") -> DataFrame:
    """exemplar, k, embedding: means of each exemplar's average-linkage clusters on cosine distance; fewer tokens than k, none."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by(pos)
        x = blocks.unit_rows(np.stack([np.asarray(v, float) for v in t.column("embedding").to_pylist()]))
        if len(x) < k:
            return pa.table({exemplar: t.column(exemplar)[:0], "k": pa.array([], pa.int32()), "embedding": pa.array([], pa.list_(pa.float64()))})
        label = blocks.linkage_labels(1 - x @ x.T, "average", k=k)
        mean = blocks.unit_rows(np.stack([x[label == c].mean(0) for c in range(label.max() + 1)]))
        return pa.table({exemplar: pa.chunked_array([t.column(exemplar).combine_chunks()[: 1]] * len(mean)), "k": pa.array(range(len(mean)), pa.int32()), "embedding": pa.array(mean.tolist(), pa.list_(pa.float64()))})

    kind = dict(tokens.dtypes)[exemplar]
    return tokens.select(exemplar, F.col(pos).alias(pos), "embedding").groupBy(exemplar).applyInArrow(run, f"{exemplar} {kind}, k int, embedding array<double>")


#: Most tokens of one exemplar, or of its cluster prototypes.
EXEMPLAR_TOKENS = 16_384


def _few(vectors: DataFrame) -> np.ndarray:
    """The vectors of one crop; more than ``EXEMPLAR_TOKENS`` are an error."""
    got = vectors.select(F.col("embedding").cast("array<double>").alias("embedding")).limit(EXEMPLAR_TOKENS + 1).toArrow()
    if got.num_rows > EXEMPLAR_TOKENS:
        raise ValueError("more tokens than one crop can have")
    return blocks.matrix(got.column(0))


def crop_scores(candidates: DataFrame, exemplar: DataFrame, clusters: DataFrame, keys: list[str]) -> DataFrame:
    """keys, m1, m2, m3 of each candidate's tokens against one exemplar (pos, embedding) and its cluster prototypes.

    m1: cosine of the mean token to the exemplar's; m2: mean over exemplar tokens of the best candidate token; m3:
    mean over candidate tokens of the best cluster prototype, null without clusters.
    """
    raw, c = _few(exemplar), blocks.unit_rows(_few(clusters))
    if not len(raw):
        return candidates.select(*keys, *[F.lit(0.0).alias(m) for m in ("m1", "m2", "m3")]).limit(0)
    e, own = blocks.unit_rows(raw), raw.mean(0)

    def run(t: pa.Table) -> pa.Table:
        raw = np.array(t.column("embedding").to_pylist())
        x, mean = blocks.unit_rows(raw), raw.mean(0)
        m1 = float(mean @ own / (np.linalg.norm(mean) * np.linalg.norm(own) + EPSILON))
        m3 = float((x @ c.T).max(1).mean()) if len(c) else None
        return pa.table({**{k: t.column(k)[:1] for k in keys}, "m1": [m1], "m2": [float((x @ e.T).max(0).mean())], "m3": pa.array([m3], pa.float64())})

    kinds = dict(candidates.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", m1 double, m2 double, m3 double"
    return candidates.select(*keys, F.col("embedding").cast("array<double>").alias("embedding")).groupBy(*keys).applyInArrow(run, schema)


def drift_matrix(prototypes: DataFrame, key: str) -> DataFrame:
    """a, b, similarity of all pairs of prototypes (a few scales)."""
    a = prototypes.select(F.col(key).alias("a"), F.col("embedding").alias("_x"))
    b = prototypes.select(F.col(key).alias("b"), F.col("embedding").alias("_y"))
    return a.join(b, how="cross").select("a", "b", cosine("_x", "_y").alias("similarity"))


def conserve_vs_distort(rows: DataFrame, keys: list[str], variant: str, ratio: str, anchor: float = 1.0) -> DataFrame:
    """keys, ratio, between (cosine of the two variants), and each variant's cosine to its own anchor ratio."""
    v = rows.groupBy(*keys, ratio).agg(F.max(F.when(F.col(variant) == "conserve", F.col("embedding"))).alias("x"), F.max(F.when(F.col(variant) == "distort", F.col("embedding"))).alias("y"))
    a = v.where(F.col(ratio) == anchor).select(*keys, F.col("x").alias("ax"), F.col("y").alias("ay"))
    on = v.join(a, keys) if keys else v.join(a, how="cross")
    return on.select(*keys, ratio, cosine("x", "y").alias("between"), cosine("x", "ax").alias("conserve"), cosine("y", "ay").alias("distort"))
