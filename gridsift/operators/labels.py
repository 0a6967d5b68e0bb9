"""Label maintenance on patch tables, and the annotation log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import pixel_to_patch


def registered_labels(df: DataFrame) -> DataFrame:
    return df.select(F.explode("labels").alias("label")).distinct().orderBy("label")


def add_labels(patches: DataFrame, subset: DataFrame, labels: list[str], keys: tuple[str, ...] = ("image_id", "row", "col")) -> DataFrame:
    """Union of ``labels`` into the rows of ``subset``; other rows stay as they are."""
    flag = subset.select(*keys).distinct().withColumn("_in", F.lit(True))
    new = F.when(F.col("_in"), F.array_union("labels", F.array(*map(F.lit, labels)).cast("array<string>"))).otherwise(F.col("labels"))
    return patches.join(flag, list(keys), "left").withColumn("labels", new).drop("_in")


def remove_labels(patches: DataFrame, subset: DataFrame, labels: list[str], keys: tuple[str, ...] = ("image_id", "row", "col")) -> DataFrame:
    """Without ``labels`` in the rows of ``subset``; absent ones do nothing."""
    flag = subset.select(*keys).distinct().withColumn("_in", F.lit(True))
    new = F.when(F.col("_in"), F.array_except("labels", F.array(*map(F.lit, labels)).cast("array<string>"))).otherwise(F.col("labels"))
    return patches.join(flag, list(keys), "left").withColumn("labels", new).drop("_in")


def labels_from_cells(patches: DataFrame, cells: DataFrame, label_map: DataFrame) -> DataFrame:
    """Add the labels that ``label_map`` (value, label) gives to ``cells`` (image_id, row, col, value).

    An image in ``cells`` without patches is an error.
    """
    known = patches.select("image_id").distinct().withColumn("_known", F.lit(True))
    checked = cells.join(known, "image_id", "left").withColumn("_ok", F.when(F.col("_known").isNull(), F.raise_error(F.concat(F.lit("unknown image_id "), F.col("image_id").cast("string"))).cast("boolean")).otherwise(True)).where("_ok")
    more = checked.join(label_map, "value").groupBy("image_id", "row", "col").agg(F.collect_set("label").alias("_new"))
    out = patches.join(more, ["image_id", "row", "col"], "left")
    return out.withColumn("labels", F.array_union("labels", F.coalesce(F.array_sort("_new"), F.array().cast("array<string>")))).drop("_new")


def register_keypoints(patches: DataFrame, points: DataFrame, image_size: int, patch_size: int) -> DataFrame:
    """Add each point's label (image_id, label, x, y, orig_w, orig_h) to the patch below it; a point without a patch is skipped."""
    n = image_size // patch_size
    at = points.select("image_id", pixel_to_patch("y", "orig_h", image_size, patch_size, n).alias("row"), pixel_to_patch("x", "orig_w", image_size, patch_size, n).alias("col"), "label")
    more = at.groupBy("image_id", "row", "col").agg(F.array_sort(F.collect_set("label")).alias("_new"))
    out = patches.join(more, ["image_id", "row", "col"], "left")
    return out.withColumn("labels", F.when(F.col("_new").isNull(), F.col("labels")).otherwise(F.array_union("labels", "_new"))).drop("_new")


def available_groups(classes: DataFrame, groups: dict[str, list[str]], image: str = "image_id", name: str = "class") -> DataFrame:
    """image, groups: names of the groups that hold any of the image's classes."""
    have = classes.groupBy(image).agg(F.collect_set(name).alias("_have"))
    hit = [F.when(F.arrays_overlap("_have", F.array(*map(F.lit, c))), F.lit(g)) for g, c in sorted(groups.items())]
    return have.select(image, F.array_compact(F.array(*hit)).alias("groups"))


def class_registry(*tables: DataFrame, default: tuple[str, ...] = ("object",)) -> DataFrame:
    """Distinct class names of the tables' ``class`` columns and the defaults, in order."""
    spark = tables[0].sparkSession
    rows = spark.createDataFrame([(x,) for x in default], "class string")
    for t in tables:
        rows = rows.unionByName(t.select(F.col("class").cast("string").alias("class")))
    return rows.where("class IS NOT NULL").distinct().orderBy("class")


def fold_log(log: DataFrame, keys: list[str], order: list[str | Column], op: str = "op") -> DataFrame:
    """Current state of an upsert/delete log: each key's last operation, without deleted ones; partial maxima, no window."""
    rest = [c for c in log.columns if c not in keys]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_x"))
    return last.select(*keys, "_x.*").where(F.col(op) != "delete")


def runs(df: DataFrame, keys: list[str], order: list[str], bit: str) -> DataFrame:
    """keys, rle: run lengths of a boolean per group, from the false count on (a leading 0 if the first is true)."""
    w = W.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("_i", F.row_number().over(w)).withColumn("_j", F.row_number().over(W.partitionBy(*keys, bit).orderBy(*order)))
    run = rows.groupBy(*keys, bit, (F.col("_i") - F.col("_j")).alias("_g")).agg(F.min("_i").alias("_at"), F.count("*").cast("int").alias("_n"))
    got = run.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_at", F.col(bit).alias("b"), F.col("_n").alias("n")))).alias("_r"))
    lead = F.when(F.get("_r", F.lit(0))["b"], F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    return got.select(*keys, F.concat(lead, F.transform("_r", lambda x: x["n"])).alias("rle"))
