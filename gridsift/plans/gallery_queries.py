"""Queries over the gallery projection of the ``embeddings`` table, and over the other tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions.vectors import cosine, l2_normalize, rounded, unit, vector_mean
from ..operators import coresets, knn, labels, masks, retrieval
from ..operators import prototypes as proto
from . import metric_queries, scoremap_queries, source_queries
from .projection import GRID, P, cls, cos_sql, greedy_sql, mean_sql, patches, round_sql, table
from .registry import query

assert metric_queries and scoremap_queries and source_queries


def r6(c):
    return F.round(c, 6).alias(c)


def vector(p: DataFrame, vec_id: int) -> list[float]:
    return p.where(F.col("vec_id") == vec_id).select("embedding").head().embedding


@query("b1_filter_patches", f"WITH {P} SELECT vec_id, image_id, \"row\", col, split FROM p WHERE label IN (1, 2, 3) AND split = 'train' AND image_id IN ('0', '1', '5', '6')")
def filter_patches(spark, sf):
    rows = retrieval.filter_patches(patches(spark, sf), any_labels=["class_1", "class_2", "class_3"], image_ids=["0", "1", "5", "6"], split="train")
    return rows.select("vec_id", "image_id", "row", "col", "split")


@query("b2_patch_centres", f'WITH {P} SELECT vec_id, CAST("row" * 14 + 7 AS INT) AS y_center, CAST(col * 14 + 7 AS INT) AS x_center FROM p')
def patch_centres(spark, sf):
    return patches(spark, sf).select("vec_id", geo.patch_centre("row", 14).alias("y_center"), geo.patch_centre("col", 14).alias("x_center"))


@query("b3_l2_normalize", f"WITH {P} SELECT vec_id, {round_sql('list_transform(e, lambda x: x / greatest(sqrt(list_dot_product(e, e)), 1e-12))')} AS hard, {round_sql('list_transform(e, lambda x: x / (sqrt(list_dot_product(e, e)) + 1e-8))')} AS soft FROM p")
def normalised(spark, sf):
    return patches(spark, sf).select("vec_id", rounded(l2_normalize("embedding")).alias("hard"), rounded(l2_normalize("embedding", soft=True)).alias("soft"))


@query("d2_retrieve_patches", f"WITH {P} SELECT vec_id, round({cos_sql('p.e', 'z.e')}, 6) AS similarity FROM p, (SELECT e FROM p WHERE vec_id = 0) z WHERE split = 'train' ORDER BY {cos_sql('p.e', 'z.e')} DESC, image_id, \"row\", col LIMIT 10")
def retrieve_patches(spark, sf):
    p = patches(spark, sf)
    return retrieval.retrieve_patches(p, vector(p, 0), 10, split="train").select("vec_id", r6("similarity"))


_CLS = f"c AS ({mean_sql('p', 'image_id, split', False)})"


@query("d1_retrieve_images", f"WITH {P}, {_CLS} SELECT c.image_id, round({cos_sql('c.e', 'z.e')}, 6) AS similarity FROM c, (SELECT e FROM p WHERE vec_id = 7) z ORDER BY {cos_sql('c.e', 'z.e')} DESC, c.image_id LIMIT 3")
def retrieve_images(spark, sf):
    p = patches(spark, sf)
    return retrieval.retrieve_images(cls(p), vector(p, 7), 3).select("image_id", r6("similarity"))


@query("d3_two_stage_retrieve", f"""WITH {P}, {_CLS}, z AS (SELECT e FROM p WHERE vec_id = 42), best AS (SELECT c.image_id FROM c, z ORDER BY {cos_sql('c.e', 'z.e')} DESC, c.image_id LIMIT 2)
SELECT vec_id, round({cos_sql('p.e', 'z.e')}, 6) AS similarity FROM p SEMI JOIN best USING (image_id), z ORDER BY {cos_sql('p.e', 'z.e')} DESC, image_id, "row", col LIMIT 8""")
def two_stage(spark, sf):
    p = patches(spark, sf)
    return retrieval.two_stage_retrieve(cls(p), p, vector(p, 42), 2, 8).select("vec_id", r6("similarity"))


def _knn_sql(k: int, where_q: str, where_b: str, value: str = "similarity") -> str:
    return f"""SELECT query_id, rank, bank_id, {value} AS similarity FROM (SELECT q.vec_id AS query_id, b.vec_id AS bank_id,
    list_dot_product(q.u, b.u) AS s, round(list_dot_product(q.u, b.u), 6) AS similarity, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.u, b.u) DESC, b.vec_id) AS INT) AS rank
    FROM u q, u b WHERE q.split = '{where_q}' AND b.split = '{where_b}') WHERE rank <= {k}"""


_U = "u AS (SELECT *, list_transform(e, lambda x: x / greatest(sqrt(list_dot_product(e, e)), 1e-12)) AS u FROM p)"


def _sides(spark, sf, q="test", b="train"):
    p = patches(spark, sf)
    side = lambda s, name: p.where(F.col("split") == s).withColumnRenamed("vec_id", name)
    return side(q, "query_id"), side(b, "bank_id")


@query("c3_knn_join", f"WITH {P}, {_U} {_knn_sql(5, 'test', 'train')}")
def knn_join(spark, sf):
    return knn.knn_join(*_sides(spark, sf), 5).withColumn("similarity", F.round("similarity", 6))


@query("c3_knn_join_blocks", f"WITH {P}, {_U} {_knn_sql(3, 'val', 'train')}")
def knn_join_blocks(spark, sf):
    return knn.knn_join(*_sides(spark, sf, "val"), 3, bank_bytes=0).withColumn("similarity", F.round("similarity", 6))


@query("c9_mutual_nn", f"""WITH {P}, {_U}, a AS ({_knn_sql(1, 'test', 'train')}), b AS ({_knn_sql(1, 'train', 'test')})
SELECT a.query_id AS a_id, a.bank_id AS b_id, a.similarity FROM a JOIN b ON a.query_id = b.bank_id AND a.bank_id = b.query_id""")
def mutual_nn(spark, sf):
    q, b = _sides(spark, sf)
    return knn.mutual_nn(q, b, "query_id", "bank_id").select("a_id", "b_id", r6("similarity"))


_H3 = f"{_U}, n AS ({_knn_sql(3, 'test', 'train', 's')}), a AS (SELECT query_id, avg(least(greatest(1 - similarity, 0), 2)) AS score FROM n GROUP BY query_id)"


def anomaly_image_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, image_score of test images against the train bank."""
    q, b = _sides(spark, sf_dir)
    rows = knn.anomaly_scores(q, b, 3).join(q.select("query_id", "image_id"), "query_id")
    return retrieval.top_fraction_mean(rows, ["image_id"], "score", 0.05).select("image_id", F.round("image_score", 4).alias("image_score"))


query("h3_anomaly_image_scores", f"""WITH {P}, {_H3}, r AS (SELECT image_id, score, count(*) OVER (PARTITION BY image_id) AS n, row_number() OVER (PARTITION BY image_id ORDER BY score DESC) AS r FROM a JOIN p ON vec_id = query_id)
SELECT image_id, round(avg(score), 4) AS image_score FROM r WHERE r <= greatest(1, CAST(floor(n * 0.05) AS INT)) GROUP BY image_id""")(anomaly_image_scores)


@query("h3_anomaly_patch_scores", f"WITH {P}, {_H3} SELECT query_id, round(score, 4) AS score FROM a")
def anomaly_patch_scores(spark, sf):
    return knn.anomaly_scores(*_sides(spark, sf), 3).select("query_id", F.round("score", 4).alias("score"))


@query("h5_score_bank", f"WITH {P}, {_U}, n AS ({_knn_sql(4, 'val', 'train', 's')}) SELECT query_id, round(avg(similarity), 4) AS score FROM n GROUP BY query_id")
def score_bank(spark, sf):
    return knn.score_bank(*_sides(spark, sf, "val"), 4).select("query_id", F.round("score", 4).alias("score"))


@query("h6_score_bank_bg", f"""WITH {P}, {_U}, n AS ({_knn_sql(10, 'test', 'train', 's')}) SELECT query_id,
round(coalesce(sum(similarity) FILTER (label < 5), 0) / greatest(1, count(*) FILTER (label < 5)), 4) AS score FROM n JOIN p ON vec_id = bank_id GROUP BY query_id""")
def score_bank_bg(spark, sf):
    q, b = _sides(spark, sf)
    return knn.score_bank_bg(q, b.withColumn("is_fg", F.col("label") < 5), 10).select("query_id", F.round("score", 4).alias("score"))


def _side_sql(cond: str) -> str:
    return f"""SELECT query_id, avg(s) AS v FROM (SELECT q.vec_id AS query_id, list_dot_product(q.u, b.u) AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.u, b.u) DESC, b.vec_id) AS r
    FROM u q, u b WHERE q.split = 'test' AND b.split = 'train' AND b.{cond}) WHERE r <= 3 GROUP BY query_id"""


@query("h8_score_fgbg_knn", f"WITH {P}, {_U}, f AS ({_side_sql('label < 5')}), g AS ({_side_sql('label >= 5')}) SELECT query_id, round(f.v - g.v, 4) AS score FROM f JOIN g USING (query_id)")
def score_fgbg_knn(spark, sf):
    q, b = _sides(spark, sf)
    return knn.score_fgbg_knn(q, b.where("label < 5"), b.where("label >= 5"), 3).select("query_id", F.round("score", 4).alias("score"))


@query("h2_coreset", f"WITH RECURSIVE {P}, {_U}, {greedy_sql('20')} SELECT new AS bank_id FROM g GROUP BY new")
def coreset(spark, sf):
    _, b = _sides(spark, sf)
    return knn.coreset(b, 20).select("bank_id")


@query("h2_coreset_batches", f"WITH RECURSIVE {P}, {_U}, {greedy_sql('20')} SELECT CAST(20 AS BIGINT) AS size, round(max(far), 6) AS best_radius, true AS within FROM g WHERE step = (SELECT max(step) FROM g)")
def coreset_batches(spark, sf):
    """20 rows from batches of 100: within twice the greedy choice's radius, as an angle."""
    _, b = _sides(spark, sf)
    best = coresets.cover_radius(b, knn.coreset(b, 20)).select(F.col("radius").alias("best"))
    width = b.select(F.max(F.size("embedding")).alias("d")).head().d
    found = coresets.cover_radius(b, knn.coreset(b, 20, batch_bytes=800 * width)).join(F.broadcast(best), F.lit(True))
    return found.select("size", F.round("best", 6).alias("best_radius"), (F.acos(1 - F.col("radius")) <= 2 * F.acos(1 - F.col("best"))).alias("within"))


@query("b8_remove_subspace", f"""WITH {P}, {_U}, b AS (SELECT u AS b FROM u WHERE vec_id = 5), x AS (SELECT vec_id, list_transform(list_zip(e, b), lambda y: y[1] - y[2] * list_dot_product(e, b)) AS x FROM u, b)
SELECT vec_id, {round_sql('list_transform(x, lambda y: y / greatest(sqrt(list_dot_product(x, x)), 1e-12))')} AS embedding FROM x WHERE vec_id <> 5""")
def remove_subspace(spark, sf):
    import numpy as np

    from ..functions.blocks import unit_rows
    from ..operators.subspace import remove_subspace as remove

    p = patches(spark, sf)
    basis = unit_rows(np.array([vector(p, 5)]))
    return remove(p.where("vec_id <> 5").select("vec_id", "embedding"), basis).select("vec_id", rounded("embedding").alias("embedding"))


@query("e1_registered_labels", f"WITH {P} SELECT DISTINCT class AS label FROM p ORDER BY 1")
def registered_labels(spark, sf):
    return labels.registered_labels(patches(spark, sf))


_PROTO = f"pr AS ({mean_sql('p', 'class')})"


@query("e3_label_prototypes", f"WITH {P}, {_PROTO} SELECT class AS label, {round_sql('e')} AS embedding FROM pr")
def label_prototypes(spark, sf):
    return proto.label_prototypes(patches(spark, sf)).select("label", rounded("embedding").alias("embedding"))


@query("e4_masked_prototype", f"""WITH {P}, m AS (SELECT *, max(CAST(label = 3 AS INT)) OVER (PARTITION BY image_id) AS has FROM p), k AS (SELECT * FROM m WHERE has = 0 OR label = 3), x AS ({mean_sql('k', 'image_id')})
SELECT image_id, {round_sql('e')} AS embedding FROM x""")
def masked_prototype(spark, sf):
    rows = proto.masked_prototype(patches(spark, sf).withColumn("mask", F.col("label") == 3), ["image_id"], "mask")
    return rows.select("image_id", rounded("embedding").alias("embedding"))


@query("e5_prototype_of_prototypes", f"""WITH {P}, t AS (SELECT *, CAST(CAST(image_id AS INT) % 2 AS VARCHAR) AS scale FROM p), i AS ({mean_sql('t', 'class, scale')}), o AS ({mean_sql('i', 'scale')}),
j AS (SELECT 'pooled' AS scale, e FROM i), w AS ({mean_sql('j', 'scale')}) SELECT scale, {round_sql('e')} AS embedding FROM o UNION ALL SELECT scale, {round_sql('e')} FROM w""")
def prototype_of_prototypes(spark, sf):
    rows = patches(spark, sf).withColumn("scale", (F.col("image_id").cast("int") % 2).cast("string"))
    return proto.prototype_of_prototypes(rows, ["label"], "scale").select("scale", rounded("embedding").alias("embedding"))


_CELLS = "ce AS (SELECT image_id, \"row\", col, e, i.label AS instance, p.label = i.label AS mask FROM p, (SELECT DISTINCT label FROM p WHERE label < 3) i)"


@query("e6_fgbg_prototypes", f"""WITH {P}, {_CELLS}, f0 AS (SELECT * FROM ce WHERE mask), f AS ({mean_sql('f0', 'image_id, instance')}), b0 AS (SELECT image_id, e FROM p WHERE label >= 3), b AS ({mean_sql('b0', 'image_id')})
SELECT image_id, instance, 'fg' AS side, {round_sql('e')} AS embedding FROM f UNION ALL SELECT image_id, NULL, 'bg', {round_sql('e')} FROM b""")
def fgbg_prototypes(spark, sf):
    p = patches(spark, sf)
    i = p.where("label < 3").select(F.col("label").alias("instance")).distinct()
    cells = p.join(F.broadcast(i), how="cross").withColumn("mask", F.col("label") == F.col("instance"))
    return proto.fgbg_prototypes(cells, ["image_id"]).select("image_id", "instance", "side", rounded("embedding").alias("embedding"))


@query("e7_fgbg_banks", f"WITH {P} SELECT vec_id, label < 3 AS is_fg FROM p")
def fgbg_banks(spark, sf):
    return proto.fgbg_banks(patches(spark, sf).withColumn("mask", F.col("label") < 3)).select("vec_id", "is_fg")


def _score_sql(agg: str) -> str:
    return f"WITH {P}, {_PROTO} SELECT vec_id, round({agg}({cos_sql('p.e', 'pr.e')}), 6) AS score FROM p, pr GROUP BY vec_id"


@query("h4_score_multi_max", _score_sql("max"))
def score_max(spark, sf):
    p = patches(spark, sf)
    return proto.score_prototypes(p, proto.label_prototypes(p), ["vec_id"], "max").select("vec_id", r6("score"))


@query("h4_score_multi_mean", _score_sql("avg"))
def score_mean(spark, sf):
    p = patches(spark, sf)
    return proto.score_prototypes(p, proto.label_prototypes(p), ["vec_id"], "mean").select("vec_id", r6("score"))


@query("h7_score_fgbg_mean", f"""WITH {P}, t AS (SELECT *, CASE WHEN label < 5 THEN 'fg' ELSE 'bg' END AS side FROM p), m AS ({mean_sql('t', 'side')})
SELECT vec_id, round(sum({cos_sql('p.e', 'm.e')} * CASE side WHEN 'fg' THEN 1 ELSE -1 END), 6) AS score FROM p, m GROUP BY vec_id""")
def score_fgbg_mean(spark, sf):
    p = patches(spark, sf)
    m = vector_mean(p.withColumn("side", F.when(F.col("label") < 5, "fg").otherwise("bg")), ["side"])
    return proto.score_fgbg_mean(p, m, ["vec_id"]).select("vec_id", r6("score"))


@query("h9_ensemble_prototypes", f"""WITH {P}, {_PROTO}, c(combo, scale) AS (VALUES ('low', 'class_0'), ('low', 'class_1'), ('high', 'class_8'), ('high', 'class_9')), j AS (SELECT combo, e FROM c JOIN pr ON scale = class), m AS ({mean_sql('j', 'combo')})
SELECT combo, {round_sql('e')} AS embedding FROM m""")
def ensemble(spark, sf):
    p = proto.label_prototypes(patches(spark, sf)).withColumnRenamed("label", "scale")
    combos = spark.createDataFrame([("low", ["class_0", "class_1"]), ("high", ["class_8", "class_9"]), ("gone", ["class_1", "none"])], "combo string, scales array<string>")
    return proto.ensemble_prototypes(p, combos, "mean").select("combo", rounded("embedding").alias("embedding"))


@query("e29_drift_matrix", f"WITH {P}, {_PROTO} SELECT a.class AS a, b.class AS b, round({cos_sql('a.e', 'b.e')}, 6) AS similarity FROM pr a, pr b")
def drift_matrix(spark, sf):
    return proto.drift_matrix(proto.label_prototypes(patches(spark, sf)), "label").select("a", "b", r6("similarity"))


@query("e30_conserve_vs_distort", f"""WITH {P}, t AS (SELECT CASE WHEN CAST(image_id AS INT) % 2 = 0 THEN 'conserve' ELSE 'distort' END AS variant, label, e FROM p), m AS ({mean_sql('t', 'variant, label')}),
v AS (SELECT x.label, x.e AS x, y.e AS y FROM m x JOIN m y ON x.label = y.label WHERE x.variant = 'conserve' AND y.variant = 'distort')
SELECT CAST(v.label AS DOUBLE) AS ratio, round({cos_sql('v.x', 'v.y')}, 6) AS "between", round({cos_sql('v.x', 'a.x')}, 6) AS conserve, round({cos_sql('v.y', 'a.y')}, 6) AS distort FROM v, (SELECT * FROM v WHERE label = 1) a""")
def conserve(spark, sf):
    variant = F.when(F.col("image_id").cast("int") % 2 == 0, "conserve").otherwise("distort")
    m = vector_mean(patches(spark, sf).select(variant.alias("variant"), F.col("label").cast("double").alias("ratio"), "embedding"), ["variant", "ratio"])
    return proto.conserve_vs_distort(m, [], "variant", "ratio").select("ratio", r6("between"), r6("conserve"), r6("distort"))


@query("g13_cumulative_prototypes", f"""WITH {P}, j AS (SELECT b.image_id AS image_id, b.vec_id AS vec_id, a.e FROM p a JOIN p b ON a.image_id = b.image_id AND a.vec_id <= b.vec_id), m AS ({mean_sql('j', 'image_id, vec_id')})
SELECT image_id, vec_id, {round_sql('e')} AS embedding FROM m""")
def cumulative(spark, sf):
    rows = patches(spark, sf).select("image_id", "vec_id", "embedding")
    return proto.cumulative_prototypes(rows, ["image_id"], "vec_id").select("image_id", "vec_id", rounded("embedding").alias("embedding"))


@query("h16_crop_scores", f"""WITH {P}, c AS (SELECT * FROM p WHERE split = 'test'), x AS (SELECT 1 AS g, * FROM p WHERE image_id = '0' AND label = 3), k AS (SELECT class, e FROM ({mean_sql('p', 'class')}) WHERE class IN ('class_1', 'class_2')),
cm AS ({mean_sql('c', 'image_id, label')}), xm AS ({mean_sql('x', 'g')}), m1 AS (SELECT image_id, label, {cos_sql('cm.e', 'xm.e')} AS m1 FROM cm, xm),
m2 AS (SELECT image_id, label, avg(s) AS m2 FROM (SELECT c.image_id, c.label, x.vec_id, max({cos_sql('c.e', 'x.e')}) AS s FROM c, x GROUP BY ALL) GROUP BY ALL),
m3 AS (SELECT image_id, label, avg(s) AS m3 FROM (SELECT c.image_id, c.label, c.vec_id, max({cos_sql('c.e', 'k.e')}) AS s FROM c, k GROUP BY ALL) GROUP BY ALL)
SELECT image_id, label, round(m1, 6) AS m1, round(m2, 6) AS m2, round(m3, 6) AS m3 FROM m1 JOIN m2 USING (image_id, label) JOIN m3 USING (image_id, label)""")
def crop_scores(spark, sf):
    p = patches(spark, sf)
    exemplar = p.where("image_id = '0' AND label = 3").select(F.col("vec_id").alias("pos"), "embedding")
    k = proto.label_prototypes(p, ["class_1", "class_2"])
    return proto.crop_scores(p.where("split = 'test'"), exemplar, k, ["image_id", "label"]).select("image_id", "label", r6("m1"), r6("m2"), r6("m3"))


@query("h10_kmeans_cosine")
def kmeans(spark, sf):
    return proto.kmeans_cosine(patches(spark, sf), 4).select("vec_id", "cluster")


@query("f7_add_labels", f"WITH {P} SELECT vec_id, CASE WHEN \"row\" = 2 THEN [class, 'band'] ELSE [class] END AS labels FROM p")
def add_labels(spark, sf):
    p = patches(spark, sf)
    return labels.add_labels(p, p.where("row = 2"), ["band"]).select("vec_id", "labels")


@query("f8_remove_labels", f"WITH {P} SELECT vec_id, CASE WHEN \"row\" = 2 AND label = 4 THEN [] ELSE [class] END AS labels FROM p")
def remove_labels(spark, sf):
    p = patches(spark, sf)
    return labels.remove_labels(p, p.where("row = 2"), ["class_4", "absent"]).select("vec_id", "labels")


@query("f9_labels_from_cells", f"WITH {P} SELECT vec_id, CASE WHEN label % 3 = 0 THEN list_sort([class, 'zero']) ELSE [class] END AS labels FROM p")
def labels_from_cells(spark, sf):
    p = patches(spark, sf)
    names = spark.createDataFrame([(0, "zero")], "value int, label string")
    rows = labels.labels_from_cells(p, p.select("image_id", "row", "col", (F.col("label") % 3).alias("value")), names)
    return rows.select("vec_id", F.array_sort("labels").alias("labels"))


@query("f10_register_keypoints", f"""WITH {P}, k AS (SELECT DISTINCT image_id, least(CAST(floor(floor((vec_id % 97) * 7 * 140 / 700.0) / 14) AS INT), 9) AS "row", least(CAST(floor(floor((vec_id % 89) * 8 * 140 / 720.0) / 14) AS INT), 9) AS col FROM p)
SELECT vec_id, CASE WHEN k.image_id IS NULL THEN [class] ELSE [class, 'point'] END AS labels FROM p LEFT JOIN k USING (image_id, "row", col)""")
def register_keypoints(spark, sf):
    p = patches(spark, sf)
    points = p.select("image_id", F.lit("point").alias("label"), (F.col("vec_id") % 89 * 8).alias("x"), (F.col("vec_id") % 97 * 7).alias("y"), F.lit(720).alias("orig_w"), F.lit(700).alias("orig_h"))
    return labels.register_keypoints(p, points, 140, 14).select("vec_id", "labels")


@query("f11_available_groups", f"""WITH {P} SELECT image_id, list_filter([CASE WHEN bool_or(label IN (7, 8, 9)) THEN 'high' END, CASE WHEN bool_or(label IN (0, 1)) THEN 'low' END], lambda x: x IS NOT NULL) AS groups FROM p GROUP BY image_id""")
def available_groups(spark, sf):
    rows = patches(spark, sf).select("image_id", F.explode("labels").alias("class"))
    return labels.available_groups(rows, {"low": ["class_0", "class_1"], "high": ["class_7", "class_8", "class_9"]})


@query("f12_fold_log", """SELECT user_id, event_type, event_id % 3 AS instance_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL HAVING arg_max(value, (ts, event_id)) >= 1""")
def fold_log(spark, sf):
    log = table(spark, sf, "events").withColumns({"instance_id": F.col("event_id") % 3, "op": F.when(F.col("value") < 1, "delete").otherwise("upsert")})
    return labels.fold_log(log, ["user_id", "event_type", "instance_id"], ["ts", "event_id"]).select("user_id", "event_type", "instance_id", "event_id", "value")


@query("f13_class_registry", "SELECT DISTINCT event_type AS class FROM events UNION SELECT 'object' ORDER BY 1")
def class_registry(spark, sf):
    return labels.class_registry(table(spark, sf, "events").select(F.col("event_type").alias("class")))


@query("f4_runs", """WITH e AS (SELECT user_id, event_type = 'error' AS b, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY ts, event_id) AS j FROM events),
r AS (SELECT user_id, b, min(i) AS i, CAST(count(*) AS INT) AS n FROM e GROUP BY user_id, b, e.i - e.j)
SELECT user_id, list_concat(CASE WHEN arg_min(b, i) THEN [CAST(0 AS INT)] ELSE [] END, list(n ORDER BY i)) AS rle FROM r GROUP BY user_id""")
def runs(spark, sf):
    e = table(spark, sf, "events").withColumn("bit", F.col("event_type") == "error")
    return labels.runs(e, ["user_id"], ["ts", "event_id"], "bit")


def _mask_cells(spark, sf):
    return patches(spark, sf).select("image_id", F.col("label").alias("mask_id"), "row", "col")


@query("c7_mask_iou", f"""WITH {P}, a AS (SELECT image_id, label AS a_id, "row", col FROM p), b AS (SELECT image_id, label % 4 AS b_id, "row", col FROM p WHERE col < 8),
i AS (SELECT image_id, a_id, b_id, count(*) AS inter FROM a JOIN b USING (image_id, "row", col) GROUP BY ALL), na AS (SELECT image_id, a_id, count(*) AS n FROM a GROUP BY ALL), nb AS (SELECT image_id, b_id, count(*) AS m FROM b GROUP BY ALL)
SELECT image_id, a_id, b_id, inter, round(inter / (n + m - inter + 1e-8), 6) AS iou FROM i JOIN na USING (image_id, a_id) JOIN nb USING (image_id, b_id)""")
def mask_iou(spark, sf):
    p = patches(spark, sf)
    a = p.select("image_id", F.col("label").alias("a_id"), "row", "col")
    b = p.where("col < 8").select("image_id", (F.col("label") % 4).alias("b_id"), "row", "col")
    return masks.mask_iou(a, b, ["image_id"], "a_id", "b_id").withColumn("iou", F.round("iou", 6))


@query("b10_min_area_filter", f"WITH {P}, m AS (SELECT image_id, label FROM p GROUP BY ALL HAVING count(*) >= 11) SELECT vec_id FROM p SEMI JOIN m USING (image_id, label)")
def min_area(spark, sf):
    return masks.min_area_filter(patches(spark, sf), ["image_id", "label"], 100, 0.11).select("vec_id")


@query("b12_union_mask", f'WITH {P} SELECT DISTINCT image_id, "row", col FROM p WHERE label IN (2, 5)')
def union_mask(spark, sf):
    rows = patches(spark, sf).withColumn("class", F.col("labels")[0])
    return masks.union_mask(masks.class_filter(rows, ["class_2", "class_5"]), ["image_id"])


_BOX = "bx AS (SELECT image_id, label, min(\"row\") AS r0, max(\"row\") + 1 AS r1, min(col) AS c0, max(col) + 1 AS c1 FROM p GROUP BY ALL)"


@query("f3_mask_bbox", f"WITH {P}, {_BOX} SELECT image_id, label, c0 AS x, r0 AS y, c1 - c0 AS w, r1 - r0 AS h FROM bx")
def mask_bbox(spark, sf):
    return masks.mask_bbox(patches(spark, sf), ["image_id", "label"]).select("image_id", "label", "x", "y", "w", "h")


@query("e12_instance_patch_sizes", f"WITH {P} SELECT image_id, label, count(*) AS size FROM p GROUP BY ALL")
def instance_sizes(spark, sf):
    return masks.instance_patch_sizes(patches(spark, sf), ["image_id", "label"])


@query("f1_mask_to_grid", f"WITH {P} SELECT image_id, \"row\" // 2 AS \"row\", col // 2 AS col, CAST(avg(CAST(label % 3 <> 0 AS INT)) >= 0.6 AS INT) AS value FROM p GROUP BY ALL")
def mask_to_grid(spark, sf):
    return masks.mask_to_grid(patches(spark, sf).withColumn("value", F.col("label") % 3), ["image_id"], 2, "fraction", threshold=0.6)


@query("f2_mask_to_grid_majority", f"""WITH {P}, n AS (SELECT image_id, "row" // 5 AS "row", col // 5 AS col, label AS value, count(*) AS n FROM p GROUP BY ALL) SELECT image_id, "row", col, arg_min(value, (-n, value)) AS value FROM n GROUP BY ALL""")
def mask_to_grid_majority(spark, sf):
    return masks.mask_to_grid(patches(spark, sf), ["image_id"], 5, "majority", "label")


@query("f2_mask_to_grid_center", f'WITH {P} SELECT image_id, "row" // 5 AS "row", col // 5 AS col, label AS value FROM p WHERE "row" % 5 = 2 AND col % 5 = 2')
def mask_to_grid_center(spark, sf):
    return masks.mask_to_grid(patches(spark, sf), ["image_id"], 5, "center", "label")


@query("b11_prefilter_candidates", f"""WITH {P}, {_BOX}, m AS ({mean_sql('p', 'image_id, label')}), z AS (SELECT e FROM ({mean_sql('p', 'class')}) WHERE class = 'class_3'), s AS (SELECT image_id, label, {cos_sql('m.e', 'z.e')} AS score FROM m, z)
SELECT image_id, label AS mask_id, round(score, 6) AS score, c0 AS x, r0 AS y, c1 - c0 AS w, r1 - r0 AS h FROM s JOIN bx USING (image_id, label) WHERE score >= 0.1""")
def prefilter(spark, sf):
    p = patches(spark, sf)
    out = masks.prefilter_candidates(_mask_cells(spark, sf), p.select("image_id", "row", "col", "embedding"), proto.label_prototypes(p, ["class_3"]), ["image_id", "mask_id"], 0.1)
    return out.withColumn("score", F.round("score", 6))


@query("f14_best_mask_for_prompt", f"""WITH {P}, {_BOX}, c AS (SELECT image_id, label AS mask_id, "row", col FROM p), h AS (SELECT bx.image_id, bx.label AS prompt_id, mask_id, count(*) AS n FROM bx JOIN c ON c.image_id = bx.image_id AND c.col >= c0 AND c.col < (c0 + c1 + 1) // 2 AND c."row" >= r0 AND c."row" < (r0 + r1 + 1) // 2 GROUP BY ALL)
SELECT image_id, prompt_id, arg_min(mask_id, (-n, mask_id)) AS mask_id FROM h GROUP BY image_id, prompt_id""")
def best_mask(spark, sf):
    cells = _mask_cells(spark, sf)
    half = lambda a, b: F.floor((F.col(a) + F.col(b) + 1) / 2).cast("int")
    prompts = _boxes(spark, sf).select("image_id", F.col("label").alias("prompt_id"), F.lit("box").alias("kind"), F.col("c0").alias("x0"), F.col("r0").alias("y0"), half("c0", "c1").alias("x1"), half("r0", "r1").alias("y1"), F.lit(0).alias("radius"))
    return masks.best_mask_for_prompt(masks.prompt_region(prompts, GRID, GRID, ["image_id"]), prompts, cells, cells.select("image_id", "mask_id").distinct(), ["image_id"])


def _boxes(spark, sf):
    return masks.mask_bbox(patches(spark, sf), ["image_id", "label"]).select("image_id", "label", "r0", "r1", "c0", "c1").withColumns({"height": F.lit(10), "width": F.lit(10)})


@query("b14_scale_crop_boxes", f"""WITH {P}, {_BOX}, k AS (SELECT image_id, label, greatest(c0 - CAST(floor((c1 - c0) * 0.5) AS INT), 0) AS x0, greatest(r0 - CAST(floor((r1 - r0) * 0.5) AS INT), 0) AS y0, least(c1 + CAST(floor((c1 - c0) * 0.5) AS INT), 10) AS x1, least(r1 + CAST(floor((r1 - r0) * 0.5) AS INT), 10) AS y1 FROM bx)
SELECT image_id, label, 'close' AS scale, x0, y0, x1, y1 FROM k UNION ALL SELECT image_id, label, 'mid', x0 // 2, y0 // 2, (x1 + 10) // 2, (y1 + 10) // 2 FROM k UNION ALL SELECT image_id, label, 'global', 0, 0, 10, 10 FROM k""")
def scale_crop_boxes(spark, sf):
    return geo.scale_crop_boxes(_boxes(spark, sf), 0.5).select("image_id", "label", "scale", "x0", "y0", "x1", "y1")


@query("b15_scale_crop_series", f"""WITH {P}, {_BOX}, t AS (SELECT image_id, label, k AS step, k / 4.0 AS t, c0 * 64 AS x0, r0 * 64 AS y0, c1 * 64 AS x1, r1 * 64 AS y1 FROM bx, range(5) r(k))
SELECT image_id, label, CAST(step AS INT) AS step, CAST(round_even(x0 * t, 0) AS INT) AS bx0, CAST(round_even(y0 * t, 0) AS INT) AS by0, CAST(round_even(640 + (x1 - 640) * t, 0) AS INT) AS bx1, CAST(round_even(640 + (y1 - 640) * t, 0) AS INT) AS by1 FROM t""")
def scale_crop_series(spark, sf):
    rows = _boxes(spark, sf).select("image_id", "label", (F.col("c0") * 64).alias("x0"), (F.col("r0") * 64).alias("y0"), (F.col("c1") * 64).alias("x1"), (F.col("r1") * 64).alias("y1"), F.lit(640).alias("width"), F.lit(640).alias("height"))
    return geo.scale_crop_series(rows, 5).select("image_id", "label", "step", "bx0", "by0", "bx1", "by1")


@query("b16_aspect_ratio_boxes", f"""WITH {P}, {_BOX}, t AS (SELECT image_id, label, r AS ratio, sqrt((c1 - c0) * (r1 - r0) * 4096 * r) AS w, sqrt((c1 - c0) * (r1 - r0) * 4096 / r) AS h, (c0 + c1) * 32 AS cx, (r0 + r1) * 32 AS cy FROM bx, (VALUES (CAST(0.5 AS DOUBLE)), (1.0), (2.0)) v(r))
SELECT image_id, label, ratio, CAST(least(greatest(round_even(cx - w / 2, 0), 0), 640) AS INT) AS ax0, CAST(least(greatest(round_even(cy - h / 2, 0), 0), 640) AS INT) AS ay0, CAST(least(greatest(round_even(cx + w / 2, 0), 0), 640) AS INT) AS ax1, CAST(least(greatest(round_even(cy + h / 2, 0), 0), 640) AS INT) AS ay1 FROM t""")
def aspect_ratio_boxes(spark, sf):
    rows = _boxes(spark, sf).select("image_id", "label", (F.col("c0") * 64).alias("x0"), (F.col("r0") * 64).alias("y0"), (F.col("c1") * 64).alias("x1"), (F.col("r1") * 64).alias("y1"), F.lit(640).alias("width"), F.lit(640).alias("height"))
    return geo.aspect_ratio_boxes(rows, [0.5, 1.0, 2.0]).select("image_id", "label", "ratio", "ax0", "ay0", "ax1", "ay1")


@query("b19_expand_tiles", f"""WITH {P} SELECT image_id, CAST(ty AS INT) AS ty, CAST(tx AS INT) AS tx, CAST(greatest(floor(tx * 200.0 - 25), 0) AS INT) AS x0, CAST(least(floor(tx * 200.0 + 225), 600) AS INT) AS x1, CAST(greatest(floor(ty * 160.0 - 20), 0) AS INT) AS y0, CAST(least(floor(ty * 160.0 + 180), 480) AS INT) AS y1
FROM (SELECT DISTINCT image_id FROM p), range(3) a(ty), range(3) b(tx)""")
def expand_tiles(spark, sf):
    images = patches(spark, sf).select("image_id").distinct().withColumns({"height": F.lit(480), "width": F.lit(600)})
    return geo.expand_tiles(images, 3, 0.125).select("image_id", "ty", "tx", "x0", "x1", "y0", "y1")


@query("b20_receptive_field_range", f"""WITH {P}, im AS (SELECT DISTINCT image_id, 600 + CAST(image_id AS INT) % 7 * 20 AS h, 600 + CAST(image_id AS INT) % 5 * 30 AS w FROM p)
SELECT o AS overlap, min(least(x1 - x0, y1 - y0)) AS min_px, max(greatest(x1 - x0, y1 - y0)) AS max_px, min(least(x1 - x0, y1 - y0)) / 16 AS min_px_per_patch, max(greatest(x1 - x0, y1 - y0)) / 16 AS max_px_per_patch FROM (
SELECT o, CAST(greatest(trunc(tx * (w / 3) - w / 3 * o), 0) AS INT) AS x0, CAST(least(trunc(tx * (w / 3) + w / 3 * (1 + o)), w) AS INT) AS x1, CAST(greatest(trunc(ty * (h / 3) - h / 3 * o), 0) AS INT) AS y0, CAST(least(trunc(ty * (h / 3) + h / 3 * (1 + o)), h) AS INT) AS y1
FROM (VALUES (CAST(0.0 AS DOUBLE)), (0.25)) v(o), range(3) a(ty), range(3) b(tx), im) GROUP BY o""")
def receptive_field(spark, sf):
    image = F.col("image_id").cast("int")
    images = patches(spark, sf).select("image_id").distinct().withColumns({"height": 600 + image % 7 * 20, "width": 600 + image % 5 * 30})
    return geo.receptive_field_range(images, 3, [0.0, 0.25], 16)


@query("b21_apply_homography", f"""WITH {P}, t AS (SELECT vec_id, (1.1 * col + 0.2 * "row" + 3) / (0.001 * col + 0.002 * "row" + 1) AS px, (-0.1 * col + 0.9 * "row" + 1) / (0.001 * col + 0.002 * "row" + 1) AS py, col, "row" FROM p)
SELECT vec_id, round(px, 6) AS px, round(py, 6) AS py, round(sqrt((px - col) ** 2 + (py - "row") ** 2), 6) AS error FROM t""")
def homography(spark, sf):
    rows = patches(spark, sf).withColumn("m", F.lit([1.1, 0.2, 3.0, -0.1, 0.9, 1.0, 0.001, 0.002, 1.0]))
    out = geo.apply_homography(rows, "m", "col", "row")
    return out.select("vec_id", r6("px"), r6("py"), F.round(geo.point_error("px", "py", "col", "row"), 6).alias("error"))


@query("b22_tile_owner", f'WITH {P} SELECT vec_id, CAST("row" // 5 * 2 + col // 5 AS INT) AS tile FROM p')
def tile_owner(spark, sf):
    return patches(spark, sf).select("vec_id", geo.tile_owner("row", "col", 5, 5, 2).alias("tile"))


@query("b5_pixel_to_patch", "SELECT l_orderkey, l_linenumber, CAST(least(floor(floor(l_partkey % 1000 * 518 / 1000.0) / 14), 36) AS INT) AS patch_row FROM lineitem")
def pixel_to_patch(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", geo.pixel_to_patch(F.col("l_partkey") % 1000, F.lit(1000), F.lit(518), F.lit(14), F.lit(37)).alias("patch_row"))


@query("b7_coordinate_grid", f'WITH {P} SELECT image_id, CAST(r AS INT) AS "row", CAST(c AS INT) AS col FROM (SELECT DISTINCT image_id FROM p), range(3) a(r), range(4) b(c)')
def coordinate_grid(spark, sf):
    return geo.coordinate_grid(patches(spark, sf).select("image_id").distinct(), 3, 4)


@query("b17_pad_and_floor_box", f"""WITH {P}, {_BOX}, t AS (SELECT image_id, label, (c0 + c1) * 32.0 AS cx, (r0 + r1) * 32.0 AS cy, greatest((c1 - c0) * 64 * 1.5, 96) AS w, greatest((r1 - r0) * 64 * 1.5, 96) AS h FROM bx)
SELECT image_id, label, CAST(greatest(trunc(cx - w / 2), 0) AS INT) AS px0, CAST(greatest(trunc(cy - h / 2), 0) AS INT) AS py0, CAST(least(trunc(cx + w / 2), 640) AS INT) AS px1, CAST(least(trunc(cy + h / 2), 640) AS INT) AS py1 FROM t""")
def pad_box(spark, sf):
    lit = F.lit
    return geo.pad_and_floor_box(_boxes(spark, sf), 0.25, 96, lit(10), lit(10), lit(640), lit(640)).select("image_id", "label", "px0", "py0", "px1", "py1")


@query("c6_skip_done", f"WITH {P} SELECT DISTINCT image_id, split FROM p WHERE split <> 'train'")
def skip_done(spark, sf):
    jobs = patches(spark, sf).select("image_id", "split").distinct()
    return retrieval.skip_done(jobs, jobs.where("split = 'train'"), ["image_id"])


@query("c5_restrict_to_images", f"WITH {P} SELECT vec_id FROM p WHERE image_id IN (SELECT image_id FROM p WHERE label = 3 AND \"row\" = 0)")
def restrict(spark, sf):
    p = patches(spark, sf)
    return retrieval.restrict_to_images(p, p.where("label = 3 AND row = 0")).select("vec_id")


@query("b13_smoke_subset", """SELECT doc_id FROM (SELECT doc_id, quality, row_number() OVER (PARTITION BY lang, quality ORDER BY doc_id) AS n FROM documents JOIN labels USING (doc_id)) WHERE n <= CASE quality WHEN 0 THEN 4 ELSE 5 END""")
def smoke_subset(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(F.col("lang").alias("category"), F.lit("test").alias("split"), F.col("quality").alias("label_index"), F.col("doc_id").alias("image_id"))
    return retrieval.smoke_subset(rows, 9).select(F.col("image_id").alias("doc_id"))


@query("c8_neighbour_similarity", f"""WITH {P} SELECT a.image_id, a."row", a.col, round({cos_sql('a.e', 'b.e')}, 6) AS similarity FROM p a JOIN p b ON a.image_id = b.image_id AND a."row" = b."row" AND b.col = a.col + 1""")
def neighbours(spark, sf):
    return masks.neighbour_similarity(patches(spark, sf), ["image_id"], "col", cosine).withColumn("similarity", F.round("similarity", 6))


@query("e2_unit_vectors_by_split", f"WITH {P}, m AS ({mean_sql('p', 'split')}) SELECT split, {round_sql('e')} AS embedding FROM m")
def unit_by_split(spark, sf):
    return unit(vector_mean(patches(spark, sf), ["split"], normalise=False), "embedding").select("split", rounded("embedding").alias("embedding"))


@query("b6_patch_to_pixel", f'WITH {P} SELECT vec_id, CAST(floor((col + 0.5) * 645 / 10) AS INT) AS x, ("row" + 0.5) * (480 / 10) AS y FROM p')
def patch_to_pixel(spark, sf):
    return patches(spark, sf).select("vec_id", geo.patch_to_pixel("col", F.lit(645), 10).alias("x"), geo.patch_to_point("row", F.lit(480), 10).alias("y"))


@query("c1_index_vectors", f'WITH {P} SELECT vec_id, round(list_sum(e), 5) AS total FROM p')
def index_vectors(spark, sf):
    p = patches(spark, sf)
    index = p.select("vec_id", "image_id", "row", "col")
    rows = index.join(p.select("image_id", "row", "col", "embedding"), ["image_id", "row", "col"])
    return rows.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v), 5).alias("total"))


@query("i3_name_parsing", """SELECT doc_id, nullif(regexp_extract(n, '^(.+)_([0-9]+)$', 1), '') AS part, TRY_CAST(regexp_extract(n, '^(.+)_([0-9]+)$', 2) AS INT) AS number, replace(n, 's', '__') AS flat
FROM (SELECT doc_id, source || CASE WHEN doc_id % 3 = 0 THEN '_' || doc_id ELSE '' END AS n FROM documents)""")
def name_parsing(spark, sf):
    from ..sources.files import part_and_role

    name = F.concat("source", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("_"), F.col("doc_id").cast("string"))).otherwise(""))
    rows = table(spark, sf, "documents").select("doc_id", name.alias("n"))
    return rows.select("doc_id", *part_and_role("n"), F.replace("n", F.lit("s"), F.lit("__")).alias("flat"))


@query("h22_subsample", f"WITH {P} SELECT vec_id FROM p ORDER BY md5('7|' || vec_id), vec_id LIMIT 50")
def subsample(spark, sf):
    return retrieval.subsample(patches(spark, sf).select("vec_id"), 50, ["vec_id"], 7)


_BITS = 'g AS (SELECT image_id, "row", col, label % 3 > 0 AS b FROM p)'
_NEAR = lambda a, b, lo, hi: f"{b}.image_id = {a}.image_id AND {b}.\"row\" BETWEEN {a}.\"row\" + {lo} AND {a}.\"row\" + {hi} AND {b}.col BETWEEN {a}.col + {lo} AND {a}.col + {hi}"


def _bit_masks(spark, sf):
    """Masks of whole grids, and as inside the cells that have a patch: an image's grid may be incomplete."""
    p = patches(spark, sf)
    bits = p.select("image_id", "row", "col", (F.col("label") % 3 > 0).alias("bit"), F.lit(True).alias("there"))
    cells = geo.coordinate_grid(p.select("image_id").distinct(), GRID, GRID).join(bits, ["image_id", "row", "col"], "left").fillna(False, ["bit", "there"])
    runs = lambda bit: labels.runs(cells, ["image_id"], ["row", "col"], bit)
    return runs("bit").join(runs("there").withColumnRenamed("rle", "inside"), "image_id").withColumns({"height": F.lit(GRID), "width": F.lit(GRID)})


@query("f5_morph_open", f"""WITH {P}, {_BITS}, e AS (SELECT a.image_id, a."row", a.col FROM g a JOIN g b ON {_NEAR("a", "b", 0, 1)} GROUP BY ALL HAVING bool_and(b.b))
SELECT DISTINCT g.image_id, g."row", g.col FROM g JOIN e ON {_NEAR("g", "e", -1, 0)}""")
def morph_open(spark, sf):
    return masks.rle_cells(masks.morph_open(_bit_masks(spark, sf), ["image_id"], 2, "inside"), ["image_id"])


@query("f6_morph_close", f"""WITH {P}, {_BITS}, d AS (SELECT a.image_id, a."row", a.col, bool_or(b.b) AS b FROM g a JOIN g b ON {_NEAR("a", "b", -1, 1)} GROUP BY ALL)
SELECT a.image_id, a."row", a.col FROM d a JOIN d b ON {_NEAR("a", "b", -1, 1)} GROUP BY ALL HAVING bool_and(b.b)""")
def morph_close(spark, sf):
    return masks.rle_cells(masks.morph_close(_bit_masks(spark, sf), ["image_id"], 1, "inside"), ["image_id"])


_UNIT = lambda v: f"list_transform({v}, lambda x: x / greatest(sqrt(list_dot_product({v}, {v})), 1e-12))"


@query("g14_cycle_consistency", f"""WITH {P}, u AS (SELECT *, {_UNIT("e")} AS u FROM p),
ce AS (SELECT image_id, 'a' AS view, "row", CAST((col + 1) % 10 AS INT) AS col, e FROM p UNION ALL SELECT p.image_id, 'b', p."row", p.col, CASE WHEN q.e IS NULL THEN p.e ELSE list_transform(list_zip(p.e, q.e), lambda x: x[1] + x[2] * 0.5::DOUBLE) END FROM p LEFT JOIN p q ON q.vec_id = p.vec_id + 100),
c AS (SELECT image_id, vec_id, (col + 0.5::DOUBLE) * 64 AS x, ("row" + 0.5::DOUBLE) * 64 AS y FROM p),
w AS (SELECT image_id, vec_id, 'a' AS view, x + 64 AS x, y FROM c UNION ALL SELECT image_id, vec_id, 'b', (x + 0.02::DOUBLE * y + 10) / (0.0001::DOUBLE * x + 1), (y - 0.02::DOUBLE * x - 6) / (0.0001::DOUBLE * x + 1) FROM c),
q AS (SELECT image_id, vec_id, view, greatest(least(x * 10 / 640.0::DOUBLE - 0.5, 9), 0) AS x, greatest(least(y * 10 / 640.0::DOUBLE - 0.5, 9), 0) AS y FROM w WHERE x >= 0 AND x < 640 AND y >= 0 AND y < 640),
k AS (SELECT image_id, vec_id, view, CAST(least(floor(y) + dy, 9) AS INT) AS "row", CAST(least(floor(x) + dx, 9) AS INT) AS col, (CASE dy WHEN 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE dx WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) AS w FROM q, range(2) a(dy), range(2) b(dx)),
v AS (SELECT image_id, vec_id, view, list(m ORDER BY i) AS v FROM (SELECT image_id, vec_id, view, i, sum(x * w) / sum(w) AS m FROM (SELECT image_id, vec_id, view, w, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM k JOIN ce USING (image_id, view, "row", col) WHERE w > 0) GROUP BY ALL) GROUP BY ALL),
n AS (SELECT v.image_id, v.vec_id, view, arg_max(u.vec_id, (list_dot_product({_UNIT("v")}, u.u), -u.vec_id)) AS back FROM v JOIN u ON u.image_id = v.image_id GROUP BY ALL),
h AS (SELECT p.image_id, p.vec_id, count(*) AS hits FROM n JOIN p ON p.vec_id = n.vec_id JOIN p b ON b.vec_id = n.back WHERE sqrt((b."row" - p."row") ** 2 + (b.col - p.col) ** 2) * 64 < 8 GROUP BY ALL),
m AS ({mean_sql("u", "image_id", False, "u")}),
r AS (SELECT image_id, vec_id, coalesce(hits, 0) / 2 AS share, list_dot_product(u.u, m.e) AS s FROM u JOIN m USING (image_id) LEFT JOIN h USING (image_id, vec_id)),
o AS (SELECT *, share > 0.4 AND s < 0.12 AS ok FROM r)
SELECT image_id, vec_id AS a_id, round(share, 6) AS share, round(s, 6) AS self_similarity, CASE WHEN bool_or(ok) OVER (PARTITION BY image_id) THEN ok ELSE row_number() OVER (PARTITION BY image_id ORDER BY share DESC, vec_id) <= 20 END AS kept FROM o""")
def cycle_consistency(spark, sf):
    from ..operators import clusters

    p = patches(spark, sf)
    views = p.select("image_id").distinct().select("image_id", F.explode(F.create_map(
        F.lit("a"), F.array(*map(F.lit, (1.0, 0.0, 64.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0))), F.lit("b"), F.array(*map(F.lit, (1.0, 0.02, 10.0, -0.02, 1.0, -6.0, 0.0001, 0.0, 1.0))),
    )).alias("view", "m"))
    own = p.select("vec_id", "image_id", "row", "col", "embedding")
    after = p.select((F.col("vec_id") - 100).alias("vec_id"), F.col("embedding").alias("_q"))
    mixed = F.when(F.col("_q").isNull(), F.col("embedding")).otherwise(F.zip_with("embedding", "_q", lambda x, y: x + y * 0.5))
    cells = own.select("image_id", F.lit("a").alias("view"), "row", ((F.col("col") + 1) % 10).cast("int").alias("col"), "embedding").unionByName(own.join(after, "vec_id", "left").select("image_id", F.lit("b").alias("view"), "row", "col", mixed.alias("embedding")))
    out = clusters.cycle_consistency(own.withColumnRenamed("vec_id", "a_id"), views, cells, ["image_id"], 0.4, 0.12, 8, 64, 10)
    return out.select("image_id", "a_id", r6("share"), r6("self_similarity"), "kept")


@query("i4_json_records", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def json_records(spark, sf):
    from ..sources.files import read_json_records

    return read_json_records(table(spark, sf, "events").select("event_id", "props"), "props", "k int").select("event_id", "record.k")
