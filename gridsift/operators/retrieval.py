"""Filters and cosine retrieval over gallery tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import EPSILON, dot, norm


def filter_patches(df: DataFrame, has_labels: list[str] | None = None, any_labels: list[str] | None = None, image_ids: list | DataFrame | None = None, split: str | None = None) -> DataFrame:
    """Rows with all of ``has_labels``, any of ``any_labels``, an image of ``image_ids`` and the split.

    An empty or absent label list does not filter; an empty list of image ids gives no rows. A DataFrame of
    image_id is semi-joined, so its size does not matter.
    """
    for x in has_labels or []:
        df = df.where(F.array_contains("labels", x))
    if any_labels:
        df = df.where(F.arrays_overlap("labels", F.array(*map(F.lit, any_labels))))
    if isinstance(image_ids, DataFrame):
        df = df.join(image_ids.select("image_id").distinct(), "image_id", "left_semi")
    elif image_ids is not None:
        df = df.where(F.col("image_id").isin(list(image_ids)) if image_ids else F.lit(False))
    return df if split is None else df.where(F.col("split") == split)


def _query(vector: list[float]) -> Column:
    return F.lit([float(x) for x in vector])


def with_similarity(df: DataFrame, vector: list[float], column: str = "embedding") -> DataFrame:
    """``df`` with the cosine of each row's vector and one query vector."""
    q = [float(x) for x in vector]
    n = sum(x * x for x in q) ** 0.5
    return df.withColumn("similarity", dot(column, _query(q)) / (norm(column) * n + EPSILON))


def retrieve(df: DataFrame, vector: list[float], k: int, keys: list[str]) -> DataFrame:
    """The k rows of greatest similarity (all, if k is more), ties by ``keys``; k rows a task at most are gathered."""
    return with_similarity(df, vector).orderBy(F.desc("similarity"), *keys).limit(k)


def retrieve_images(cls: DataFrame, vector: list[float], k: int, image_ids=None, split: str | None = None) -> DataFrame:
    return retrieve(filter_patches(cls, image_ids=image_ids, split=split), vector, k, ["image_id"])


def retrieve_patches(patches: DataFrame, vector: list[float], k: int, **filters) -> DataFrame:
    return retrieve(filter_patches(patches, **filters), vector, k, ["image_id", "row", "col"])


def two_stage_retrieve(cls: DataFrame, patches: DataFrame, vector: list[float], k_images: int, k: int, **filters) -> DataFrame:
    """Patches of the k_images best images only."""
    images = retrieve_images(cls, vector, k_images, split=filters.get("split")).select("image_id")
    return retrieve_patches(patches.join(F.broadcast(images), "image_id", "left_semi"), vector, k, **filters)


def retrieve_images_batch(cls: DataFrame, queries: DataFrame, k: int, image_ids=None, split: str | None = None) -> DataFrame:
    """query_id, rank, image_id, similarity: the k best images of each of many queries (query_id, embedding)."""
    from .knn import knn_join
    from .ranks import numbered

    images = numbered(filter_patches(cls, image_ids=image_ids, split=split).select("image_id", "embedding"), [F.asc("image_id")], "_image")  # ties by image_id
    found = knn_join(queries, images, k, "query_id", "_image")
    return found.join(images.select(F.col("_image").alias("bank_id"), "image_id"), "bank_id").select("query_id", "rank", "image_id", "similarity")


def two_stage_retrieve_batch(cls: DataFrame, patches: DataFrame, queries: DataFrame, k_images: int, k: int, **filters) -> DataFrame:
    """query_id, rank, image_id, row, col, similarity: for each query, the k best patches of its k_images best images.

    A query meets the patches of k_images images only; each task cuts its share to k before the ranks are taken.
    """
    images = retrieve_images_batch(cls, queries, k_images, split=filters.get("split")).select("query_id", "image_id")
    q = images.join(queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").alias("_q")), "query_id")
    rows = q.join(filter_patches(patches, **filters).select("image_id", "row", "col", "embedding"), "image_id")
    rows = rows.select("query_id", "image_id", "row", "col", (dot("embedding", "_q") / (norm("embedding") * norm("_q") + EPSILON)).alias("similarity"))
    return top_per_group(rows, ["query_id"], k, [F.desc("similarity"), F.asc("image_id"), F.asc("row"), F.asc("col")])


def top_per_group(df: DataFrame, keys: list[str], k: int, order: list[Column]) -> DataFrame:
    """The first k rows of each group, with their rank; Spark cuts each task's share to k before the shuffle."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def restrict_to_images(df: DataFrame, images: DataFrame) -> DataFrame:
    return df.join(images.select("image_id").distinct(), "image_id", "left_semi")


def skip_done(jobs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return jobs.join(done.select(*keys).distinct(), keys, "left_anti")


def smoke_subset(df: DataFrame, limit: int) -> DataFrame:
    """Per category, max(1, limit // 2) normal and max(1, limit - that) anomalous test rows, and max(limit, 5) train rows, by image_id."""
    normal = max(1, limit // 2)
    cap = F.when(F.col("split") == "train", max(limit, 5)).when(F.col("label_index") == 0, normal).otherwise(max(1, limit - normal))
    n = F.row_number().over(W.partitionBy("category", "split", "label_index").orderBy("image_id"))
    return df.withColumn("_n", n).where(F.col("_n") <= cap).drop("_n")


def subsample(df: DataFrame, cap: int, key: list[str], seed: int = 0) -> DataFrame:
    """At most ``cap`` rows, those with the least seeded hashes of their keys: the same at any partitioning."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key])), *key).limit(cap)


def top_fraction_mean(df: DataFrame, keys: list[str], score: str, share: float = 0.01) -> DataFrame:
    """Mean of the largest max(1, int(n * share)) scores of each group as image_score."""
    w = W.partitionBy(*keys)
    rows = df.withColumn("_n", F.count("*").over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.desc(score))))
    return rows.where(F.col("_r") <= F.greatest(F.lit(1), (F.col("_n") * share).cast("int"))).groupBy(*keys).agg(F.avg(score).alias("image_score"))
