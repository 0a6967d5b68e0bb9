"""Image folders, annotations, mask archives and score tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import blocks
from .archives import MASKS, escaped, list_files, register, write_files

IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp")
ANNOTATION = "class string, instance_id int, prompt_type string, prompt_content string, image_path string"


def stem(path: str):
    """The file name without folder and last extension."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def make_image_id(label: str, path: str):
    """'<label>_<stem>', as stems repeat across label folders."""
    return F.concat_ws("_", F.col(label), stem(path))


def flat_name(path: str):
    return F.replace(path, F.lit("/"), F.lit("__"))


def part_and_role(name: str):
    """'<part>_<n>' -> part and number; another name has neither."""
    return F.nullif(F.regexp_extract(name, r"^(.+)_(\d+)$", 1), F.lit("")).alias("part"), F.regexp_extract(name, r"^(.+)_(\d+)$", 2).try_cast("int").alias("number")


def list_images(spark: SparkSession, folder: str, extensions: tuple[str, ...] = IMAGE_EXTENSIONS) -> DataFrame:
    """path, length of image files below ``folder``, sorted, without those under an ``annotations`` folder; contents are not read."""
    rows = list_files(spark, folder)
    fits = F.lower("path").rlike(r"\.(" + "|".join(extensions) + ")$")
    return rows.where(fits & ~F.array_contains(F.split("path", "/"), "annotations")).orderBy("path")


def _arrays(data: bytes) -> dict[str, np.ndarray]:
    if data[:6] == b"\x93NUMPY":
        return {"": np.load(io.BytesIO(data), allow_pickle=False)}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return {n.removesuffix(".npy"): np.load(io.BytesIO(z.read(n)), allow_pickle=False) for n in z.namelist()}


def read_mask_stacks(spark: SparkSession, folder: str, glob: str = "*.npy", key: str = "", path: bool = False) -> DataFrame:
    """stem (and path, if asked for), pos, n, height, width, rle of (N, H, W) mask arrays; an array that is not 3-D fails the read. An empty stack has no rows."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder).select(stem("path").alias("stem"), "path", "content")
    names = ["stem", "path", "pos", "n", "height", "width", "rle"]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for name, file, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                m = _arrays(data)[key]
                if m.ndim != 3:
                    raise ValueError(f"{name}: masks must be (N, H, W)")
                rows = [(name, file, i, len(m), m.shape[1], m.shape[2], blocks.rle_encode(x)) for i, x in enumerate(m)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), *[pa.int32()] * 4, pa.list_(pa.int32())), strict=True)], names)

    found = files.mapInArrow(run, "stem string, path string, pos int, n int, height int, width int, rle array<int>")
    return found if path else found.drop("path")


def read_annotations(spark: SparkSession, folder: str) -> DataFrame:
    """Annotation records of <stem>.json (an array) joined by position to the masks of <stem>.npy in the same folder.

    A missing mask file, or another number of masks than records (none included), fails the read. Equal stems in two
    folders are kept apart by ``folder``.
    """
    place = lambda path: F.regexp_replace(F.regexp_extract(path, r"^(.*)/[^/]+$", 1), "^file:/+", "file:/").alias("folder")
    raw = spark.read.option("wholetext", "true").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").text(folder)
    records = raw.select(place("_metadata.file_path"), stem("_metadata.file_path").alias("stem"), F.from_json("value", f"array<struct<{ANNOTATION.replace(' string', ':string').replace(' int', ':int')}>>").alias("r"))
    masks = read_mask_stacks(spark, folder, path=True).withColumn("folder", place("path")).drop("path")
    counts = masks.groupBy("folder", "stem").agg(F.count("*").alias("_m"))
    checked = records.join(counts, ["folder", "stem"], "left")
    wrong = F.coalesce("_m", F.lit(0)) != F.size("r")
    rows = checked.withColumn("r", F.when(wrong, F.raise_error(F.concat(F.col("stem"), F.lit(": masks and records differ"))).cast(checked.schema["r"].dataType)).otherwise(F.col("r")))
    rows = rows.select("folder", "stem", F.posexplode("r").alias("pos", "a")).select("folder", "stem", "pos", "a.*")
    return rows.join(masks.drop("n"), ["folder", "stem", "pos"])


def write_masks(cells: DataFrame, path: str, height: int, width: int, boxes: DataFrame | None = None) -> int:
    """Write <image_id>.npz with segmentations, bboxes and has_bbox for each image of ``cells`` (image_id, mask_id, row, col); the number of files.

    ``boxes`` has image_id, mask_id and bbox (4 integers); masks without one get -1s. Masks are in order of mask_id. Image
    ids are escaped in file names. Files appear when all are written; a failed job leaves none.
    """
    masks = cells.groupBy("image_id", "mask_id").agg(F.collect_list(F.col("row") * width + F.col("col")).alias("at"))
    masks = masks.join(boxes.select("image_id", "mask_id", "bbox"), ["image_id", "mask_id"], "left") if boxes is not None else masks.withColumn("bbox", F.lit(None).cast("array<int>"))
    images = masks.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("mask_id", "at", "bbox"))).alias("masks"))  # one image's masks

    def archives(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for i in range(batch.num_rows):
                image, masks = (c[0].as_py() for c in batch.slice(i, 1).columns)
                m = np.zeros((len(masks), height * width), bool)
                for k, x in enumerate(masks):
                    m[k, x["at"]] = True
                has = np.array([x["bbox"] is not None for x in masks])
                box = np.array([x["bbox"] if x["bbox"] is not None else [-1] * 4 for x in masks], np.int32).reshape(-1, 4)
                out = io.BytesIO()
                np.savez(out, segmentations=m.reshape(-1, height, width), bboxes=box, has_bbox=has)
                yield pa.RecordBatch.from_arrays([pa.array([f"{escaped(image)}.npz"]), pa.array([out.getvalue()], pa.binary())], ["name", "content"])

    found = images.select(F.col("image_id").cast("string").alias("image_id"), "masks")
    write_files(found.mapInArrow(archives, "name string, content binary"), path)
    return cells.select("image_id").distinct().count()


def read_proposals(spark: SparkSession, folder: str, columns: list[str] | None = None) -> DataFrame:
    """image_id, mask_id, bbox (null where the archive has none), height, width, rle of .npz archives with segmentations, bboxes and has_bbox.

    With ``columns``, only these are read: without height, width and rle no pixels are.
    """
    register(spark)
    kinds = dict(x.strip().split(" ") for x in MASKS.split(","))
    schema = ", ".join(f"{c} {kinds[c]}" for c in (columns or kinds))
    return spark.read.format("gridsift_masks").schema(schema).load(folder)


def write_annotations(cells: DataFrame, path: str, height: int, width: int) -> None:
    """Write <image_id>.json, an array of records, and <image_id>.npy, the masks in the same order, for each image.

    ``cells`` has image_id, class, instance_id, prompt_type, prompt_content, image_path, row and col; records go by class
    and instance_id. Image ids are escaped in file names. Files appear when all are written.
    """
    fields = ["class", "instance_id", "prompt_type", "prompt_content", "image_path"]
    masks = cells.groupBy("image_id", *fields).agg(F.collect_list(F.col("row") * width + F.col("col")).alias("at"))
    images = masks.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct(*fields, "at"))).alias("r"))  # one image's records
    images = images.select(F.col("image_id").cast("string"), F.to_json(F.transform("r", lambda x: x.dropFields("at"))).alias("records"), F.transform("r", lambda x: x["at"]).alias("masks"))

    def both(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for image, records, masks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                m = np.zeros((len(masks), height * width), bool)
                for k, at in enumerate(masks):
                    m[k, at] = True
                out = io.BytesIO()
                np.save(out, m.reshape(-1, height, width))
                yield pa.RecordBatch.from_arrays([pa.array([f"{escaped(image)}.json", f"{escaped(image)}.npy"]), pa.array([records.encode(), out.getvalue()], pa.binary())], ["name", "content"])

    write_files(images.mapInArrow(both, "name string, content binary"), path)


def read_union_masks(spark: SparkSession, folder: str, suffix: str = "_mask_good", key: str = "segmaps", axis: int | None = None) -> DataFrame:
    """stem, height, width, rle: the union over instances of <stem><suffix>.npz.

    The instance axis is ``axis`` (0 or -1); if that is None, the first or last one, whichever is shorter, and a stack
    whose first and last are equally long is an error.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}.npz").option("recursiveFileLookup", "true").load(folder).select(F.regexp_extract(stem("path"), f"^(.*){suffix}$", 1).alias("stem"), "content")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for name, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                m = _arrays(data)[key].astype(bool)
                if m.ndim == 3:
                    if axis is None and m.shape[0] == m.shape[-1]:
                        raise ValueError(f"{name}: either axis may be that of the instances")
                    m = m.any(axis if axis is not None else 0 if m.shape[0] < m.shape[-1] else -1)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([m.shape[0]], pa.int32()), pa.array([m.shape[1]], pa.int32()), pa.array([blocks.rle_encode(m)], pa.list_(pa.int32()))], ["stem", "height", "width", "rle"])

    return files.mapInArrow(run, "stem string, height int, width int, rle array<int>")


def read_labeled_folder(images: DataFrame, masks: DataFrame, normal: str = "good") -> DataFrame:
    """path, split, label, label_index, mask_path of image paths '<split>/<label>/<file>' and mask paths '<label>/<stem>_mask.<ext>'."""
    part = lambda k: F.element_at(F.split("path", "/"), k)
    rows = images.select("path", part(-3).alias("split"), part(-2).alias("label"), stem("path").alias("_stem"))
    m = masks.select(F.col("path").alias("mask_path"), part(-2).alias("label"), F.regexp_replace(stem("path"), "_mask$", "").alias("_stem"))
    out = rows.join(m, ["label", "_stem"], "left").withColumn("label_index", (F.col("label") != normal).cast("int"))
    return out.select("path", "split", "label", "label_index", "mask_path")


def write_scores(df: DataFrame, path: str) -> None:
    df.repartition("category", "method").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("category", "method").parquet(path)


def read_scores(spark: SparkSession, path: str, pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """Score records of the wanted (category, method) pairs; absent ones are skipped, and a 'nan', 'None' or '' mask path is null."""
    df = spark.read.parquet(path)
    if pairs is not None:
        df = df.where(F.struct("category", "method").isin([F.struct(F.lit(a), F.lit(b)) for a, b in pairs]) if pairs else F.lit(False))
    return df.withColumn("mask_path", F.when(~F.lower("mask_path").isin("nan", "none", ""), F.col("mask_path")))


def write_metrics_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def write_results_json(df: DataFrame, path: str, keys: list[str], digits: int = 4) -> None:
    """One JSON object for each group of ``keys`` with its rows as ``candidates``; doubles are rounded, nulls stay."""
    cols = [F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c not in keys]
    df.groupBy(*keys).agg(F.collect_list(F.struct(*cols)).alias("candidates")).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_json_records(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Rows of ``df`` with the JSON of ``column`` as ``record``; malformed ones are skipped."""
    return df.withColumn("record", F.from_json(column, f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})).where("record IS NOT NULL AND record._broken IS NULL").withColumn("record", F.col("record").dropFields("_broken"))
