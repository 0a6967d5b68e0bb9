"""Queries of sources and sinks: given tables written, read back and compared; memory banks, batch retrieval and streams."""

from __future__ import annotations

import io
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions.vectors import rounded
from ..operators import features, knn, masks, retrieval, subspace
from ..sources import archives, files, gallery
from ..sources.shared import shared_path
from ..streaming import streams
from .projection import GRID, P, cls, cos_sql, greedy_sql, mean_sql, patches, round_sql, table
from .registry import query

_CLS = f"c AS ({mean_sql('p', 'image_id, split', False)})"


def _features(spark, sf):
    """Feature rows of two blocks, patches and CLS rows."""
    p = patches(spark, sf)
    rows = p.select("image_id", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "embedding")
    rows = rows.unionByName(cls(p).select("image_id", F.lit(None).cast("int").alias("row"), F.lit(None).cast("int").alias("col"), "embedding"))
    rows = rows.withColumn("block", F.explode(F.array(F.lit(4), F.lit(11))))
    return rows.withColumn("embedding", F.transform("embedding", lambda x: F.when(F.col("block") == 4, 2 * x).otherwise(x)).cast("array<float>"))


def _gallery(spark, sf):
    p, path = patches(spark, sf), shared_path(spark, "gallery")
    features = _features(spark, sf)
    config = gallery.config_from_features(features, "model", "v1", "base", 14, 140)
    image_labels = p.select("image_id", F.array(F.concat(F.lit("image_"), F.col("image_id"))).alias("labels")).distinct()
    gallery.write_gallery(features, config, path, image_labels, p.where("label < 3").select("image_id", "row", "col", "labels"), p.select("image_id", "split").distinct())
    return gallery.read_gallery(spark, path)


@query("a1_gallery_patches", f"""WITH {P} SELECT image_id, "row", col, CAST("row" * 14 + 7 AS INT) AS y_center, CAST(col * 14 + 7 AS INT) AS x_center, CASE WHEN label < 3 THEN ['image_' || image_id, class] ELSE ['image_' || image_id] END AS labels, split FROM p""")
def gallery_patches(spark, sf):
    found = _gallery(spark, sf).patches
    return found.select("image_id", *[F.col(c).cast("int").alias(c) for c in ("row", "col", "y_center", "x_center")], "labels", "split")


@query("a3_config_from_features", "SELECT [4, 11] AS block_indices, max(len(embedding)) AS embed_dim, 14 AS patch_size FROM embeddings")
def config_from_features(spark, sf):
    return _gallery(spark, sf).config.select("block_indices", "embed_dim", "patch_size")


@query("a4_gallery_vectors", f"WITH {P} SELECT image_id, \"row\", col, round(2 * list_sum(e), 4) AS total FROM p WHERE split = 'train'")
def gallery_vectors(spark, sf):
    g = _gallery(spark, sf)
    rows = g.load_embeddings(g.patches.where("split = 'train'"), 4)
    return rows.select("image_id", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v), 4).alias("total"))


@query("a5_gallery_grid", f"WITH {P} SELECT \"row\", col, {round_sql('e')} AS embedding FROM p WHERE image_id = '1'")
def gallery_grid(spark, sf):
    return _gallery(spark, sf).load_image_grid("1").select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), rounded(F.col("embedding").cast("array<double>")).alias("embedding"))


@query("a6_gallery_cls", f"WITH {P}, {_CLS} SELECT image_id, split, round(2 * list_sum(e), 3) AS total FROM c")
def gallery_cls(spark, sf):
    rows = _gallery(spark, sf).load_cls(block=4)
    return rows.select("image_id", "split", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v), 3).alias("total"))


@query("a9_masks_round_trip", f"""WITH {P}, b AS (SELECT image_id, label, CASE WHEN label % 2 = 0 THEN [min(col), min("row"), max(col) + 1 - min(col), max("row") + 1 - min("row")] END AS bbox FROM p GROUP BY image_id, label),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY image_id ORDER BY label) - 1 AS INT) AS mask_id FROM b) SELECT image_id, mask_id, bbox, "row", col FROM k JOIN p USING (image_id, label)""")
def masks_round_trip(spark, sf):
    path = shared_path(spark, "masks")
    cells = patches(spark, sf).select("image_id", F.col("label").alias("mask_id"), "row", "col")
    box = masks.mask_bbox(cells, ["image_id", "mask_id"]).where("mask_id % 2 = 0").select("image_id", "mask_id", F.array("x", "y", "w", "h").alias("bbox"))
    files.write_masks(cells, path, GRID, GRID, box)
    found = files.read_proposals(spark, path)
    return masks.rle_cells(found, ["image_id", "mask_id", "bbox"])


def _files(rows, folder, name, content=None):
    """``rows`` as files of that name and content below ``folder``."""
    content = F.lit("x") if content is None else content
    archives.write_files(rows.select(name.alias("name"), content.cast("binary").alias("content")), folder)


@query("a7_list_images", "SELECT 'p' || page_id || CASE page_id % 3 WHEN 0 THEN '.PNG' ELSE '.jpeg' END AS name, octet_length(encode(coalesce(html, ''))) AS length FROM pages WHERE page_id % 3 < 2 AND page_id % 5 > 0")
def list_images(spark, sf):
    """Pages as files: every third is a text, every fifth lies in an annotations folder."""
    n, folder = F.col("page_id"), shared_path(spark, "images")
    kind = F.when(n % 3 == 0, ".PNG").when(n % 3 == 1, ".jpeg").otherwise(".txt")
    _files(table(spark, sf, "pages"), folder, F.concat(F.when(n % 5 == 0, "annotations/").otherwise("set/deep/"), F.lit("p"), n.cast("string"), kind), F.coalesce("html", F.lit("")))
    return files.list_images(spark, folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")


@query("a8_annotations_round_trip", f"""WITH {P}, r AS (SELECT image_id, class, label, CAST(row_number() OVER (PARTITION BY image_id ORDER BY class) - 1 AS INT) AS pos FROM p GROUP BY image_id, class, label)
SELECT image_id AS stem, pos, class, label AS instance_id, 'box' AS prompt_type, 'images/' || image_id || '.png' AS image_path, "row", col FROM r JOIN p USING (image_id, class, label)""")
def annotations_round_trip(spark, sf):
    folder = shared_path(spark, "annotations")
    cells = patches(spark, sf).select("image_id", F.col("labels")[0].alias("class"), F.col("label").alias("instance_id"), F.lit("box").alias("prompt_type"), F.lit("{}").alias("prompt_content"), F.concat(F.lit("images/"), "image_id", F.lit(".png")).alias("image_path"), "row", "col")
    files.write_annotations(cells, folder, GRID, GRID)
    found = files.read_annotations(spark, folder)
    return masks.rle_cells(found, ["stem", "pos", "class", "instance_id", "prompt_type", "image_path"])


@query("a9_boxes_without_pixels", f"""WITH {P}, b AS (SELECT image_id, label, [min(col), min("row"), max(col) + 1 - min(col), max("row") + 1 - min("row")] AS bbox FROM p GROUP BY image_id, label)
SELECT image_id || '/x' AS image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY label) - 1 AS INT) AS mask_id, bbox FROM b""")
def boxes_without_pixels(spark, sf):
    """Only the boxes of the archives are read; image ids with a '/' come back as they were."""
    path = shared_path(spark, "boxes")
    cells = patches(spark, sf).select(F.concat("image_id", F.lit("/x")).alias("image_id"), F.col("label").alias("mask_id"), "row", "col")
    box = masks.mask_bbox(cells, ["image_id", "mask_id"]).select("image_id", "mask_id", F.array("x", "y", "w", "h").alias("bbox"))
    files.write_masks(cells, path, GRID, GRID, box)
    return files.read_proposals(spark, path, ["image_id", "mask_id", "bbox"])


@query("a10_labeled_folder", """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'good' ELSE coalesce(lang, 'none') END AS label, CASE WHEN doc_id % 4 = 0 THEN 'test' ELSE 'train' END AS split FROM documents)
SELECT split || '/' || label || '/d' || doc_id || '.png' AS path, split, label, CAST(label <> 'good' AS INT) AS label_index, CASE WHEN label <> 'good' AND doc_id % 2 = 0 THEN label || '/d' || doc_id || '_mask.png' END AS mask_path FROM d""")
def labeled_folder(spark, sf):
    n, root = F.col("doc_id"), shared_path(spark, "labelled")
    label, split = F.when(n % 3 == 0, "good").otherwise(F.coalesce("lang", F.lit("none"))), F.when(n % 4 == 0, "test").otherwise("train")
    d = table(spark, sf, "documents").select("doc_id", label.alias("label"), split.alias("split"))
    _files(d, f"{root}/images", F.concat_ws("/", "split", "label", F.concat(F.lit("d"), n.cast("string"), F.lit(".png"))))
    _files(d.where("label <> 'good' AND doc_id % 2 = 0"), f"{root}/truth", F.concat_ws("/", "label", F.concat(F.lit("d"), n.cast("string"), F.lit("_mask.png"))))
    found = files.read_labeled_folder(files.list_images(spark, f"{root}/images"), files.list_images(spark, f"{root}/truth"))
    last = lambda c, k: F.array_join(F.slice(F.split(c, "/"), -k, k), "/")
    return found.withColumn("path", last("path", 3)).withColumn("mask_path", last("mask_path", 2))


@query("a11_image_ids", "SELECT page_id, 'l' || page_id % 4 || '_p' || page_id || '.v' || page_id % 3 AS image_id FROM pages")
def image_ids(spark, sf):
    n = F.col("page_id").cast("string")
    rows = table(spark, sf, "pages").select("page_id", F.concat(F.lit("l"), (F.col("page_id") % 4).cast("string")).alias("label"), F.concat(F.lit("a/b/p"), n, F.lit(".v"), (F.col("page_id") % 3).cast("string"), F.lit(".png")).alias("path"))
    return rows.select("page_id", files.make_image_id("label", F.col("path")).alias("image_id"))


@query("a16_union_masks", f"WITH {P} SELECT DISTINCT image_id AS stem, \"row\", col FROM p WHERE label % 3 > 0")
def union_masks(spark, sf):
    """Stacks of one mask a label, the instance axis first in even images and last in odd ones; some files lack the suffix."""
    folder = shared_path(spark, "stacks")
    cells = patches(spark, sf).where("label % 3 > 0").groupBy("image_id").agg(F.collect_list(F.struct(F.col("label").cast("int").alias("k"), "row", "col")).alias("cells"))

    def stacks(batches):
        for batch in batches:
            for image, cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                known = sorted({c["k"] for c in cells})
                m = np.zeros((len(known), GRID + 2, GRID + 2), bool)
                for c in cells:
                    m[known.index(c["k"]), c["row"], c["col"]] = True
                for name, x in ((f"{image}_mask_good.npz", m if int(image) % 2 == 0 else np.moveaxis(m, 0, -1)), (f"{image}_other.npz", ~m)):
                    out = io.BytesIO()
                    np.savez(out, segmaps=x)
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([out.getvalue()], pa.binary())], ["name", "content"])

    archives.write_files(cells.mapInArrow(stacks, "name string, content binary"), folder)
    return masks.rle_cells(files.read_union_masks(spark, folder), ["stem"])


def _images(spark, sf):
    """image_id, content: the vectors and labels of each image's grid as JSON bytes."""
    cells = F.array_sort(F.collect_list(F.struct("row", "col", "embedding", "label")))
    return patches(spark, sf).groupBy("image_id").agg(F.to_json(cells).cast("binary").alias("content"))


@query("k1_extract_features", f"""WITH {P}, {_CLS}, f AS (SELECT image_id, 0 AS block, "row", col, e FROM p UNION ALL SELECT image_id, 0, NULL, NULL, e FROM c)
SELECT image_id, block, "row", col, round(list_sum(e), 3) AS total FROM f UNION ALL SELECT image_id, 2, "row", col, round(3 * list_sum(e), 3) FROM f""")
def extract_features(spark, sf):
    """A toy model of three blocks, whose k-th gives k + 1 times the image's vectors; two images at once."""

    def load():
        def embed(contents):
            images = [json.loads(x) for x in contents]
            grids = np.zeros((len(images), GRID, GRID, len(images[0][0]["embedding"])))
            inside = np.zeros(grids.shape[:3], bool)
            for b, cells in enumerate(images):
                at = b, [c["row"] for c in cells], [c["col"] for c in cells]
                grids[at], inside[at] = [c["embedding"] for c in cells], True
            layers = np.stack([grids, 3 * grids], 1)
            return layers.sum((2, 3)) / inside.sum((1, 2))[:, None, None], layers, inside

        return embed

    rows = features.extract_features(_images(spark, sf), load, features.resolve_layers([0, 2], 3), 2)
    return rows.select("image_id", "block", "row", "col", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v), 3).alias("total"))


@query("k2_propose_masks", f"""WITH {P}, m AS (SELECT image_id, label, CASE WHEN label % 2 = 0 THEN min(col) END AS x, CASE WHEN label % 2 = 0 THEN count(*)::DOUBLE END AS score FROM p GROUP BY image_id, label),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY image_id ORDER BY label) - 1 AS INT) AS mask_id FROM m) SELECT image_id, mask_id, x, score, "row", col FROM k JOIN p USING (image_id, label)""")
def propose_masks(spark, sf):
    """A toy model that proposes the cells of each label, with a box and a score for even ones."""

    def load():
        def propose(content):
            cells, out = json.loads(content), []
            for k in sorted({c["label"] for c in cells}):
                mask = np.zeros((GRID, GRID), bool)
                at = np.array([(c["row"], c["col"]) for c in cells if c["label"] == k])
                mask[at[:, 0], at[:, 1]] = True
                y, x = at.min(0).tolist()
                out.append((mask, (x, y, 1, 1), float(len(at))) if k % 2 == 0 else (mask, None, None))
            return out

        return propose

    return masks.rle_cells(features.propose_masks(_images(spark, sf), load), ["image_id", "mask_id", "x", "score"])


@query("k3_methods", f"""WITH {P}, t AS (SELECT avg(e[1]) AS m FROM p WHERE split = 'train') SELECT 'mean' AS method, image_id, round(max(abs(e[1] - m)), 6) AS score, NULL AS error FROM p, t WHERE split = 'test' GROUP BY image_id
UNION ALL SELECT 'broken', NULL, NULL, 'no model'""")
def methods(spark, sf):
    """A method that works, beside one that fails."""
    known, p = features.Methods(), patches(spark, sf)
    first = F.col("embedding")[0]

    def broken(train):
        raise ValueError("no model")

    known.register("mean", lambda train: train.agg(F.avg(first).alias("m")).head().m, lambda m, test: test.groupBy("image_id").agg(F.round(F.max(F.abs(first - m)), 6).alias("score")))
    known.register("broken", broken, lambda state, test: test)
    done, failed = known.run_all(known.names(), p.where("split = 'train'"), p.where("split = 'test'"))
    out = spark.createDataFrame([(k, None, None, e) for k, e in failed.items()], "method string, image_id string, score double, error string")
    for k, rows in done.items():
        out = out.unionByName(rows.select(F.lit(k).alias("method"), "image_id", "score", F.lit(None).cast("string").alias("error")))
    return out


@query("a13_scores_round_trip", """SELECT event_type AS category, 'm' || user_id % 3 AS method, event_id, value AS score, CASE WHEN event_id % 4 = 3 THEN 'masks/' || event_id END AS mask_path FROM events WHERE event_type IN ('view', 'click') AND user_id % 3 = 1""")
def scores_round_trip(spark, sf):
    path = shared_path(spark, "scores")
    e = F.col("event_id")
    mask = F.when(e % 4 == 0, "nan").when(e % 4 == 1, "None").when(e % 4 == 2, "").otherwise(F.concat(F.lit("masks/"), e.cast("string")))
    rows = table(spark, sf, "events").select(F.col("event_type").alias("category"), F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("method"), "event_id", F.col("value").alias("score"), mask.alias("mask_path"))
    files.write_scores(rows, path)
    return files.read_scores(spark, path, [("view", "m1"), ("click", "m1"), ("absent", "m1")]).select("category", "method", "event_id", "score", "mask_path")


@query("a15_results_json", "SELECT user_id, event_id, round(value, 4) AS value FROM events")
def results_json(spark, sf):
    path = shared_path(spark, "results")
    files.write_results_json(table(spark, sf, "events").select("user_id", "event_id", "value"), path, ["user_id"])
    rows = spark.read.schema("user_id long, candidates array<struct<event_id: long, value: double>>").json(path)
    return rows.select("user_id", F.explode("candidates").alias("c")).select("user_id", "c.event_id", "c.value")


@query("a16_metrics_csv", "SELECT event_type AS method, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def metrics_csv(spark, sf):
    path = shared_path(spark, "metrics")
    files.write_metrics_csv(table(spark, sf, "events").groupBy(F.col("event_type").alias("method")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")), path)
    return spark.read.option("header", "true").schema("method string, n long, mean double").csv(path)


@query("d4_retrieve_images_batch", f"""WITH {P}, {_CLS}, q AS (SELECT vec_id, e FROM p WHERE split = 'test'), s AS (SELECT vec_id AS query_id, image_id, {cos_sql('c.e', 'q.e')} AS s FROM c, q WHERE split = 'train'),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC) AS INT) AS rank FROM s) SELECT query_id, rank, image_id, round(s, 5) AS similarity FROM r WHERE rank <= 2""")
def retrieve_images_batch(spark, sf):
    p = patches(spark, sf)
    found = retrieval.retrieve_images_batch(cls(p), p.where("split = 'test'").withColumnRenamed("vec_id", "query_id"), 2, split="train")
    return found.select("query_id", "rank", "image_id", F.round("similarity", 5).alias("similarity"))


@query("d4_two_stage_batch", f"""WITH {P}, {_CLS}, q AS (SELECT vec_id, e FROM p WHERE split = 'test'), s AS (SELECT vec_id AS query_id, image_id, {cos_sql('c.e', 'q.e')} AS s, q.e FROM c, q WHERE split = 'train'),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC) AS r FROM s) WHERE r <= 2),
t AS (SELECT query_id, p.image_id, "row", col, {cos_sql('p.e', 'b.e')} AS s FROM b JOIN p ON p.image_id = b.image_id), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, image_id, "row", col) AS INT) AS rank FROM t)
SELECT query_id, rank, image_id, "row", col, round(s, 6) AS similarity FROM r WHERE rank <= 5""")
def two_stage_batch(spark, sf):
    p = patches(spark, sf)
    found = retrieval.two_stage_retrieve_batch(cls(p), p, p.where("split = 'test'").withColumnRenamed("vec_id", "query_id"), 2, 5, split="train")
    return found.select("query_id", "rank", "image_id", "row", "col", F.round("similarity", 6).alias("similarity"))


@query("h1_memory_bank", f"""WITH {P}, j AS (SELECT a.vec_id, b.e FROM p a JOIN p b ON a.image_id = b.image_id AND abs(a."row" - b."row") <= 1 AND abs(a.col - b.col) <= 1 WHERE a.split = 'train' AND a.label < 5), m AS ({mean_sql('j', 'vec_id')})
SELECT vec_id AS bank_id, {round_sql('e')} AS embedding FROM m""")
def memory_bank(spark, sf):
    p = patches(spark, sf).withColumnRenamed("vec_id", "bank_id")
    return knn.memory_bank(p, smoothing=True, split="train", any_labels=[f"class_{k}" for k in range(5)]).select("bank_id", rounded("embedding").alias("embedding"))


@query("h1_memory_bank_coreset", f"""WITH RECURSIVE {P}, u AS (SELECT *, list_transform(e, lambda x: x / greatest(sqrt(list_dot_product(e, e)), 1e-12)) AS u FROM p),
{greedy_sql("(SELECT greatest(1, CAST(floor(count(*) * 0.03) AS INT)) FROM x)")} SELECT new AS bank_id FROM g GROUP BY new""")
def memory_bank_coreset(spark, sf):
    return knn.memory_bank(patches(spark, sf).withColumnRenamed("vec_id", "bank_id"), ratio=0.03, split="train").select("bank_id")


@query("h11_subspace_variance", f"WITH {P}, u AS (SELECT list_transform(e, lambda x: x / greatest(sqrt(list_dot_product(e, e)), 1e-12)) AS u FROM p), d AS (SELECT i, var_pop(x) AS v FROM (SELECT unnest(u) AS x, generate_subscripts(u, 1) AS i FROM u) GROUP BY i) SELECT round(sum(v), 6) AS total, count(*) AS dimensions FROM d")
def subspace_variance(spark, sf):
    p = patches(spark, sf)
    d = p.select(F.max(F.size("embedding")).alias("d")).head().d
    _, _, variance = subspace.fit_subspace(p, d)
    return spark.createDataFrame([(round(float(variance.sum()), 6), len(variance))], "total double, dimensions long")


@query("h17_exemplar_clusters")
def exemplar_clusters(spark, sf):
    from ..operators import prototypes

    p = patches(spark, sf).select(F.col("image_id").alias("exemplar_id"), F.col("vec_id").alias("pos"), "embedding")
    return prototypes.exemplar_clusters(p, 4).select("exemplar_id", "k", rounded("embedding").alias("embedding"))


@query("j1_stream_anomaly_scores", f"""WITH {P}, u AS (SELECT *, list_transform(e, lambda x: x / greatest(sqrt(list_dot_product(e, e)), 1e-12)) AS u FROM p),
n AS (SELECT q.vec_id, q.image_id, list_dot_product(q.u, b.u) AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.u, b.u) DESC, b.vec_id) AS r FROM u q, u b WHERE b.split = 'train'),
a AS (SELECT image_id, vec_id, avg(least(greatest(1 - s, 0), 2)) AS score FROM n WHERE r <= 3 GROUP BY ALL), t AS (SELECT *, count(*) OVER (PARTITION BY image_id) AS n, row_number() OVER (PARTITION BY image_id ORDER BY score DESC) AS r FROM a)
SELECT image_id, round(avg(score), 4) AS image_score FROM t WHERE r <= greatest(1, CAST(floor(n * 0.05) AS INT)) GROUP BY image_id""")
def stream_anomaly_scores(spark, sf):
    p = patches(spark, sf)
    arriving, path = shared_path(spark, "arriving"), shared_path(spark, "stream-scores")
    number = p.where("embedding IS NOT NULL").groupBy("image_id").agg(F.count("*").alias("expected"))  # a grid may lack cells
    rows = p.select("image_id", "row", "col", "embedding").join(number, "image_id")
    files = spark.sparkContext.defaultParallelism  # of a batch, of which there are three
    rows.repartition(3 * files).write.parquet(arriving)  # images are cut across batches
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(arriving)
    bank = p.where("split = 'train'").withColumnRenamed("vec_id", "bank_id")
    streams.stream_anomaly_scores(stream, bank, 3, path, shared_path(spark, "checkpoint"), "expected", 0.05).awaitTermination()
    return spark.read.schema("image_id string, image_score double").parquet(path).select("image_id", F.round("image_score", 4).alias("image_score"))


@query("j2_stream_annotations", """SELECT user_id, event_type, event_id % 3 AS instance_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL""")
def stream_annotations(spark, sf):
    arriving, path = shared_path(spark, "log"), shared_path(spark, "state")
    log = table(spark, sf, "events").select("user_id", "event_type", (F.col("event_id") % 3).alias("instance_id"), "ts", "event_id", "value", F.lit("upsert").alias("op"))
    log.repartition(4, "event_id").write.parquet(arriving)
    keys, order = ["user_id", "event_type", "instance_id"], ["ts", "event_id"]
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(arriving)
    checkpoint = shared_path(spark, "checkpoint")
    streams.stream_annotations(stream, keys, order, path, checkpoint).awaitTermination()
    return streams.read_annotations_state(spark, checkpoint).select(*keys, "event_id", "value")
