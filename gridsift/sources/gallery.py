"""Gallery tables on disk: configuration, patch index, CLS index and vectors, as Parquet and JSON.

The patch index and each block's vectors are bucketed and sorted by (image_id, row, col) into one number of buckets, kept
beside them, so index rows meet their vectors without a shuffle of either.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import patch_centre

CONFIG = "model_name string, version string, size string, patch_size int, image_size int, block_indices array<int>, embed_dim int, created_at string, schema_version string"
PATCHES = "image_id string, row smallint, col smallint, y_center smallint, x_center smallint, labels array<string>, split string"
VECTORS = "image_id string, row smallint, col smallint, embedding array<float>, block int"
CELL = ["image_id", "row", "col"]
CLS = "image_id string, labels array<string>, split string, embedding array<float>, block int"


@dataclass
class Gallery:
    config: DataFrame
    patches: DataFrame
    vectors: DataFrame
    cls: DataFrame
    path: str
    buckets: int

    def blocks(self) -> list[int]:
        return list(self.config.head().block_indices)

    def block(self, block: int | None = None) -> int:
        """The block asked for, or the last stored one; an unknown one is an error."""
        known = self.blocks()
        if block is None:
            return known[-1]
        if block not in known:
            raise ValueError(f"block {block} is not among {known}")
        return block

    def load_embeddings(self, index: DataFrame, block: int | None = None) -> DataFrame:
        """``index`` rows with their vectors, read from one block's folder only; the vectors are not shuffled."""
        v = _bucketed(index.sparkSession, f"{self.path}/vectors/block={self.block(block)}", VECTORS.removesuffix(", block int"), self.buckets)
        return index.withColumns({c: F.col(c).cast("smallint") for c in ("row", "col")}).join(v, CELL)

    def load_image_grid(self, image_id: str, block: int | None = None) -> DataFrame:
        v = self.vectors.where((F.col("block") == self.block(block)) & (F.col("image_id") == image_id))
        return v.orderBy("row", "col")

    def load_cls(self, image_ids: DataFrame | None = None, block: int | None = None) -> DataFrame:
        rows = self.cls.where(F.col("block") == self.block(block))
        return rows if image_ids is None else rows.join(image_ids.select("image_id").distinct(), "image_id", "left_semi")


def config_from_features(features: DataFrame, model_name: str, version: str, size: str, patch_size: int, image_size: int) -> dict:
    """The configuration of feature rows: their blocks in order and vector length, the model's own settings, and the time (UTC)."""
    found = features.groupBy("block").agg(F.max(F.size("embedding")).alias("d")).orderBy("block").collect()  # one row for each block
    if not found:
        raise ValueError("no features to describe")
    return {
        "model_name": model_name, "version": version, "size": size, "patch_size": patch_size, "image_size": image_size,
        "block_indices": [r.block for r in found], "embed_dim": max(r.d for r in found), "created_at": datetime.now(UTC).isoformat(), "schema_version": "1",
    }


def _table(path: str) -> str:
    return f"gridsift_{hashlib.md5(path.encode()).hexdigest()}"


def _bucketed(spark: SparkSession, path: str, schema: str, buckets: int) -> DataFrame:
    """The files at ``path`` as a table of this session that knows their buckets."""
    keys = ", ".join(f"`{c}`" for c in CELL)
    columns = ", ".join("`{}` {}".format(*c.strip().split(" ", 1)) for c in schema.split(", "))
    place = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {_table(path)} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {buckets} BUCKETS LOCATION '{place}'")
    spark.catalog.refreshTable(_table(path))
    return spark.table(_table(path))


def _write_bucketed(rows: DataFrame, path: str, buckets: int, append: bool) -> None:
    spark = rows.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {_table(path)}")
    if append:
        _bucketed(spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields), buckets)
    writer = rows.repartition(buckets, *CELL).write.format("parquet").bucketBy(buckets, *CELL).sortBy(*CELL).option("path", path)
    writer.mode("append" if append else "overwrite").saveAsTable(_table(path))


def write_gallery(
    features: DataFrame, config: dict, path: str, image_labels: DataFrame | None = None, patch_labels: DataFrame | None = None, splits: DataFrame | None = None, buckets: int | None = None, append: bool = False
) -> None:
    """Write feature rows (image_id, block, row, col, embedding; CLS rows without row and col) as a gallery.

    image_labels: image_id, labels; patch_labels: image_id, row, col, labels; splits: image_id, split. A patch's labels
    are the union of its image's and its own; an image's CLS row has the image's only. There are as many ``buckets`` as
    shuffle partitions, unless given. With ``append``, rows of further images are added to a gallery of the same blocks,
    in its buckets; ``config`` and ``buckets`` are the gallery's own then.
    """
    spark = features.sparkSession
    empty = F.array().cast("array<string>")
    image_labels = image_labels if image_labels is not None else spark.createDataFrame([], "image_id string, labels array<string>")
    patch_labels = patch_labels if patch_labels is not None else spark.createDataFrame([], "image_id string, row int, col int, labels array<string>")
    splits = splits if splits is not None else spark.createDataFrame([], "image_id string, split string")
    small = lambda c: F.col(c).cast("smallint").alias(c)
    mode = "append" if append else "overwrite"
    if append:
        old = read_gallery(spark, path)
        config, buckets = old.config.head().asDict(), old.buckets
        found = sorted(r.block for r in features.select("block").distinct().collect())  # one row a block
        if found != sorted(config["block_indices"]):
            raise ValueError(f"the gallery has blocks {config['block_indices']}, not {found}")
    else:
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.createDataFrame([config], CONFIG).coalesce(1).write.mode("overwrite").json(f"{path}/config")
        spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").json(f"{path}/layout")
    of_image = image_labels.select("image_id", F.col("labels").alias("_i"))
    cls = features.where("row IS NULL").join(of_image, "image_id", "left").join(splits, "image_id", "left")
    cls.select("image_id", F.coalesce("_i", empty).alias("labels"), "split", "embedding", "block").write.mode(mode).partitionBy("block").parquet(f"{path}/cls")
    cells = features.where("row IS NOT NULL")
    for block in config["block_indices"]:
        _write_bucketed(cells.where(F.col("block") == block).select("image_id", small("row"), small("col"), F.col("embedding").cast("array<float>")), f"{path}/vectors/block={block}", buckets, append)
    first = config["block_indices"][0]
    own = patch_labels.select("image_id", "row", "col", F.col("labels").alias("_p"))
    index = cells.where(F.col("block") == first).select("image_id", "row", "col").join(of_image, "image_id", "left").join(own, ["image_id", "row", "col"], "left").join(splits, "image_id", "left")
    centre = lambda c: patch_centre(c, config["patch_size"]).cast("smallint")
    index = index.select("image_id", small("row"), small("col"), centre("row").alias("y_center"), centre("col").alias("x_center"), F.array_union(F.coalesce("_i", empty), F.coalesce("_p", empty)).alias("labels"), "split")
    _write_bucketed(index, f"{path}/patches", buckets, append)


def read_gallery(spark: SparkSession, path: str) -> Gallery:
    r = spark.read
    buckets = r.schema("buckets int").json(f"{path}/layout").head().buckets
    return Gallery(r.schema(CONFIG).json(f"{path}/config"), _bucketed(spark, f"{path}/patches", PATCHES, buckets), r.schema(VECTORS).parquet(f"{path}/vectors"), r.schema(CLS).parquet(f"{path}/cls"), path, buckets)
