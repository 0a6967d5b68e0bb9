"""Queries over score maps, clusters and detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import cosine, rounded
from ..operators import clusters, detection, masks, reports, scoremaps
from ..operators import prototypes as proto
from .projection import GRID, P, S, cos_sql, mean_sql, patches, round_sql, scores
from .registry import query

KEY = ["image_id"]


def r6(c):
    return F.round(c, 6).alias(c)


@query("b9_density", f'WITH {P}, {S} SELECT image_id, "row", col, round(greatest(score - 0.05, 0), 6) AS density FROM s')
def density(spark, sf):
    return scores(spark, sf).select("image_id", "row", "col", F.round(scoremaps.density("score", 0.05), 6).alias("density"))


@query("g18_minmax_scale", f'WITH {P}, {S} SELECT image_id, "row", col, round((score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w + 1e-8), 6) AS score FROM s WINDOW w AS (PARTITION BY image_id)')
def minmax(spark, sf):
    return scoremaps.minmax_scale(scores(spark, sf), KEY).select("image_id", "row", "col", r6("score"))


_PEAKS = """pk AS (SELECT a.image_id, a."row", a.col, a.score FROM s a JOIN s b ON a.image_id = b.image_id AND abs(a."row" - b."row") <= 1 AND abs(a.col - b.col) <= 1 GROUP BY ALL HAVING max(b.score) = a.score AND a.score > 0.05)"""


@query("g1_peaks", f"WITH {P}, {S}, {_PEAKS} SELECT * FROM pk")
def peaks(spark, sf):
    return scoremaps.peaks(scores(spark, sf), KEY, 3, 0.05).select("image_id", "row", "col", "score")


@query("e8_threshold_sweep", f"""WITH {P}, {S}, b AS (SELECT image_id, min(score) AS lo, max(score) AS hi, count(*) FILTER (truth) AS pos FROM s GROUP BY image_id),
c AS (SELECT b.*, i, lo + i * ((hi - lo) / 20) AS c FROM b, range(21) r(i)), v AS (SELECT c.image_id, i, c, count(*) FILTER (score > c AND truth) / (count(*) FILTER (score > c OR truth) + 1e-8) AS iou FROM c JOIN s ON s.image_id = c.image_id GROUP BY ALL)
SELECT image_id, round(arg_min(c, (-iou, i)), 6) AS threshold, round(arg_min(iou, (-iou, i)), 6) AS best_iou FROM v GROUP BY image_id""")
def threshold_sweep(spark, sf):
    return scoremaps.threshold_sweep(scores(spark, sf), KEY, 21).select("image_id", r6("threshold"), r6("best_iou"))


@query("e9_pooled_threshold", f"""WITH {P}, {S}, b AS (SELECT split, min(score) AS lo, max(score) AS hi FROM s GROUP BY split),
c AS (SELECT b.*, i, lo + i * ((hi - lo) / 10) AS c FROM b, range(11) r(i)), v AS (SELECT c.split, i, c, count(*) FILTER (score > c AND truth) / (count(*) FILTER (score > c OR truth) + 1e-8) AS iou FROM c JOIN s ON s.split = c.split GROUP BY ALL)
SELECT split, round(arg_min(c, (-iou, i)), 6) AS threshold, round(arg_min(iou, (-iou, i)), 6) AS best_iou FROM v GROUP BY split""")
def pooled_threshold(spark, sf):
    return scoremaps.pooled_threshold(scores(spark, sf), ["split"], 11).select("split", r6("threshold"), r6("best_iou"))


for _m, _sql in {
    "mean": "avg(score) FILTER (truth) - 0.01", "median": "median(score) FILTER (truth) - 0.01", "min": "min(score) FILTER (truth) - 0.01",
    "max_false": "max(score) FILTER (NOT truth) + 0.01", "midpoint": "(avg(score) FILTER (truth) + avg(score) FILTER (NOT truth)) / 2",
}.items():
    query(f"e10_gt_threshold_{_m}", f"WITH {P}, {S} SELECT split, round({_sql}, 6) AS threshold FROM s GROUP BY split")(
        lambda spark, sf, m=_m: scoremaps.gt_score_threshold(scores(spark, sf), ["split"], m, 0.01).select("split", r6("threshold"))
    )


@query("e10_gt_threshold_youden", f"""WITH {P}, {S}, j AS (SELECT a.split, a.score, count(*) FILTER (b.score >= a.score AND b.truth) / count(*) FILTER (b.truth) - count(*) FILTER (b.score >= a.score AND NOT b.truth) / count(*) FILTER (NOT b.truth) AS j
FROM (SELECT DISTINCT split, score FROM s) a JOIN s b ON a.split = b.split GROUP BY ALL) SELECT split, arg_min(score, (-round(j, 12), score)) AS threshold FROM j GROUP BY split""")
def youden(spark, sf):
    return scoremaps.gt_score_threshold(scores(spark, sf), ["split"], "youden")


_SIZES = "z AS (SELECT image_id, label, count(*) AS size FROM p GROUP BY ALL)"
for _m, _lo, _hi in (
    ("median", "median(size) - 2", "median(size) + 2"), ("range", "min(size) - 2", "max(size) + 2"),
    ("std", "avg(size) - 1.5 * stddev_pop(size)", "avg(size) + 1.5 * stddev_pop(size)"), ("quartiles", "quantile_cont(size, 0.25) - 2", "quantile_cont(size, 0.75) + 2"),
):
    query(f"e11_cluster_size_bounds_{_m}", f"WITH {P}, {_SIZES} SELECT label, CAST(greatest(round_even(CAST({_lo} AS DOUBLE), 0), 2) AS INT) AS lo, CAST(greatest(round_even(CAST({_hi} AS DOUBLE), 0), 2) AS INT) AS hi FROM z GROUP BY label")(
        lambda spark, sf, m=_m: scoremaps.cluster_size_bounds(masks.instance_patch_sizes(patches(spark, sf), ["image_id", "label"]), ["label"], m, 2, 1.5)
    )


@query("e13_true_false_split", f"""WITH {P}, {S} SELECT image_id, {", ".join(f"round({f}(score) FILTER ({c}), 6) AS {n}_{a}" for n, c in (("true", "truth"), ("false", "NOT truth")) for f, a in (("min", "min"), ("avg", "mean"), ("median", "median"), ("max", "max")))} FROM s GROUP BY image_id""")
def true_false(spark, sf):
    out = scoremaps.true_false_split(scores(spark, sf), KEY)
    return out.select("image_id", *[r6(c) for c in out.columns[1:]])


_OTSU = """h AS (SELECT image_id, CAST(trunc((score - lo) / (hi - lo) * 255) AS INT) AS b, count(*) AS n, lo, hi FROM (SELECT *, min(score) OVER (PARTITION BY image_id) AS lo, max(score) OVER (PARTITION BY image_id) AS hi FROM s) GROUP BY ALL),
g AS (SELECT *, sum(n) OVER u AS n1, sum(b * n) OVER u AS s1, sum(n) OVER w AS nn, sum(b * n) OVER w AS ss FROM h WINDOW u AS (PARTITION BY image_id ORDER BY b), w AS (PARTITION BY image_id)),
v AS (SELECT *, coalesce(n1 * (nn - n1) * (s1 / n1 - (ss - s1) / nullif(nn - n1, 0)) * (s1 / n1 - (ss - s1) / nullif(nn - n1, 0)), -1) AS v FROM g),
o AS (SELECT image_id, arg_min(lo, (-round(v, 6), b)) + arg_min(b, (-round(v, 6), b)) / 255 * (arg_min(hi, (-round(v, 6), b)) - arg_min(lo, (-round(v, 6), b))) AS threshold FROM v GROUP BY image_id)"""


@query("e14_otsu_threshold", f"WITH {P}, {S}, {_OTSU} SELECT image_id, round(threshold, 6) AS threshold FROM o")
def otsu(spark, sf):
    return scoremaps.otsu_threshold(scores(spark, sf), KEY).select("image_id", r6("threshold"))


@query("e15_roi_mask_otsu", f'WITH {P}, {S}, {_OTSU} SELECT image_id, "row", col FROM s JOIN o USING (image_id) WHERE score > threshold')
def roi_otsu(spark, sf):
    return scoremaps.roi_mask(scores(spark, sf), KEY, "otsu").select("image_id", "row", "col")


@query("e15_roi_mask_percentile", f'WITH {P}, {S}, o AS (SELECT image_id, quantile_cont(score, 0.9) AS threshold FROM s GROUP BY image_id) SELECT image_id, "row", col FROM s JOIN o USING (image_id) WHERE score > threshold')
def roi_percentile(spark, sf):
    return scoremaps.roi_mask(scores(spark, sf), KEY, "percentile", 90).select("image_id", "row", "col")


@query("g10_localize_keypoint", f"""WITH {P}, {S}, t AS (SELECT image_id, arg_min("row", (-score, "row", col)) AS r, arg_min(col, (-score, "row", col)) AS c, max(score) AS m FROM s GROUP BY image_id),
w AS (SELECT s.image_id, "row", col, exp((score - m) / 0.1) * exp(-(("row" - r) ** 2 + (col - c) ** 2) / 8.0) AS w FROM s JOIN t USING (image_id))
SELECT image_id, round(sum(col * w) / sum(w), 6) AS x, round(sum("row" * w) / sum(w), 6) AS y FROM w GROUP BY image_id""")
def localize(spark, sf):
    return scoremaps.localize_keypoint(scores(spark, sf), KEY, 2.0, 0.1).select("image_id", r6("x"), r6("y"))


@query("g11_find_keypoints", f"""WITH {P}, pr AS ({mean_sql("p", "class")}), k AS (SELECT p.image_id, pr.class AS label, "row", col, round({cos_sql("p.e", "pr.e")}, 6) AS score FROM p, pr)
SELECT image_id, label, (arg_min(col, (-score, "row", col)) + 0.5) * 64.0 AS x, (arg_min("row", (-score, "row", col)) + 0.5) * 48.0 AS y, max(score) AS similarity FROM k GROUP BY ALL""")
def find_keypoints(spark, sf):
    p = patches(spark, sf)
    s = proto.score_prototypes(p, proto.label_prototypes(p), ["image_id", "row", "col"], "max", ["label"]).withColumns({"score": F.round("score", 6), "height": F.lit(480), "width": F.lit(640)})
    return scoremaps.find_keypoints(s, ["image_id", "label"], "height", "width", GRID)


@query("g7_splat_max", f"""WITH {P}, {S}, f AS (SELECT image_id, "row" // 2 AS "row", col // 2 AS col, max(score) AS f FROM s GROUP BY ALL) SELECT s.image_id, s."row", s.col, greatest(score, coalesce(f, score)) AS score FROM s LEFT JOIN f USING (image_id, "row", col)""")
def splat_max(spark, sf):
    s = scores(spark, sf)
    fine = s.withColumns({"row": F.floor(F.col("row") / 2).cast("int"), "col": F.floor(F.col("col") / 2).cast("int")})
    return scoremaps.splat_max(s, fine, KEY).select("image_id", "row", "col", "score")


@query("g8_project_cells", f"""WITH {P}, {S} SELECT DISTINCT image_id, CAST(least(floor((100 + ("row" + 0.5) * 30) * 10 / 640.0), 9) AS INT) AS "row", CAST(least(floor((200 + (col + 0.5) * 20) * 10 / 640.0), 9) AS INT) AS col FROM s WHERE truth""")
def project_cells(spark, sf):
    cells = scores(spark, sf).where("truth").withColumns({"px0": F.lit(200), "px1": F.lit(400), "py0": F.lit(100), "py1": F.lit(400)})
    return scoremaps.project_cells(cells, KEY, 10, 10, 640)


@query("g9_splat_bilinear", f"""WITH {P}, t AS (SELECT image_id, e, "row" * 0.5 AS y, col * 0.75 AS x FROM p), c AS (SELECT image_id, CAST(floor(y) + dy AS INT) AS "row", CAST(floor(x) + dx AS INT) AS col, e, (CASE dy WHEN 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE dx WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) AS w FROM t, range(2) a(dy), range(2) b(dx)),
u AS (SELECT image_id, "row", col, i, sum(x * w) / sum(w) AS m FROM (SELECT image_id, "row", col, w, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM c WHERE w > 0) GROUP BY ALL), v AS (SELECT image_id, "row", col, list(m ORDER BY i) AS v FROM u GROUP BY ALL)
SELECT image_id, "row", col, {round_sql("list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12))")} AS embedding FROM v""")
def splat_bilinear(spark, sf):
    rows = patches(spark, sf).withColumns({"y": F.col("row") * 0.5, "x": F.col("col") * 0.75, "edge": F.lit(1.0)})
    return scoremaps.splat_bilinear(rows, KEY).select("image_id", "row", "col", rounded("embedding").alias("embedding"))


@query("g15_sample_bilinear", f"""WITH {P}, q AS (SELECT image_id, vec_id AS point_id, greatest(least(vec_id * 13 % 640 * 10 / 640.0 - 0.5, 9), 0) AS x, greatest(least(vec_id * 29 % 640 * 10 / 640.0 - 0.5, 9), 0) AS y FROM p),
c AS (SELECT image_id, point_id, CAST(least(floor(y) + dy, 9) AS INT) AS "row", CAST(least(floor(x) + dx, 9) AS INT) AS col, (CASE dy WHEN 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE dx WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) AS w FROM q, range(2) a(dy), range(2) b(dx)),
u AS (SELECT image_id, point_id, i, sum(x * w) / sum(w) AS m FROM (SELECT image_id, point_id, w, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM c JOIN p USING (image_id, "row", col) WHERE w > 0) GROUP BY ALL), v AS (SELECT image_id, point_id, list(m ORDER BY i) AS v FROM u GROUP BY ALL)
SELECT image_id, point_id, {round_sql("list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12))")} AS embedding FROM v""")
def sample_bilinear(spark, sf):
    p = patches(spark, sf)
    points = p.select("image_id", F.col("vec_id").alias("point_id"), (F.col("vec_id") * 13 % 640).alias("x"), (F.col("vec_id") * 29 % 640).alias("y"))
    return scoremaps.sample_bilinear(points, p.select("image_id", "row", "col", "embedding"), KEY, 10, 640).select("image_id", "point_id", rounded("embedding").alias("embedding"))


@query("c11_pooled_compare", f"""WITH {P}, t AS (SELECT image_id, "row" // 2 AS r, col // 2 AS c, e FROM p), m AS ({mean_sql("t", "image_id, r, c")})
SELECT m.image_id, m.r AS "row", m.c AS col, round({cos_sql("m.e", "p.e")}, 6) AS similarity FROM m JOIN p ON m.image_id = p.image_id AND m.r = p."row" AND m.c = p.col""")
def pooled_compare(spark, sf):
    p = patches(spark, sf)
    m = scoremaps.pooled(p, KEY, 2).withColumnRenamed("embedding", "_m")
    return m.join(p, ["image_id", "row", "col"]).select("image_id", "row", "col", F.round(cosine("_m", "embedding"), 6).alias("similarity"))


@query("g2_box_smooth", f"""WITH {P}, j AS (SELECT a.vec_id, b.e FROM p a JOIN p b ON a.image_id = b.image_id AND abs(a."row" - b."row") <= 1 AND abs(a.col - b.col) <= 1), m AS ({mean_sql("j", "vec_id", False)})
SELECT vec_id, {round_sql("e")} AS embedding FROM m""")
def box_smooth(spark, sf):
    p = patches(spark, sf)
    s = scoremaps.box_smooth_vectors(p.drop("labels"), KEY)
    return s.join(p.select("vec_id", "image_id", "row", "col"), ["image_id", "row", "col"]).select("vec_id", rounded("embedding").alias("embedding"))


_LINKS = """link AS (SELECT a.image_id, a.cell AS x, b.cell AS y FROM c0 a JOIN c0 b ON a.image_id = b.image_id AND abs(a."row" - b."row") <= 1 AND abs(a.col - b.col) <= 1),
reach AS (SELECT image_id, x, y FROM link UNION SELECT r.image_id, r.x, l.y FROM reach r JOIN link l ON r.image_id = l.image_id AND r.y = l.x),
lead AS (SELECT image_id, x AS cell, min(y) AS lead FROM reach GROUP BY ALL)"""
_COMP = f"""c0 AS (SELECT image_id, "row", col, score, "row" * 100 + col AS cell FROM s WHERE score > 0.0),
{_LINKS}"""


@query("g3_connected_components", f"""WITH RECURSIVE {P}, {S}, {_COMP} SELECT image_id, lead AS first_cell, count(*) AS size, max(score) AS score FROM c0 JOIN lead USING (image_id, cell) GROUP BY image_id, lead""")
def components(spark, sf):
    c = clusters.connected_components(scores(spark, sf).where("score > 0.0"), KEY)
    return c.groupBy("image_id", "cluster_id").agg(F.min(F.col("row") * 100 + F.col("col")).alias("first_cell"), F.count("*").alias("size"), F.max("score").alias("score")).drop("cluster_id")


_NEXT = 'a.image_id = b.image_id AND abs(a."row" - b."row") <= 1 AND abs(a.col - b.col) <= 1'


@query("g3_grid_dbscan", f"""WITH RECURSIVE {P}, {S}, c AS (SELECT image_id, "row", col, score, "row" * 100 + col AS cell FROM s WHERE score > 0.05),
k AS (SELECT a.image_id, a."row", a.col, a.cell FROM c a JOIN c b ON {_NEXT} GROUP BY ALL HAVING count(*) >= 3), link AS (SELECT a.image_id, a.cell AS x, b.cell AS y FROM k a JOIN k b ON {_NEXT}),
reach AS (SELECT image_id, x, y FROM link UNION SELECT r.image_id, r.x, l.y FROM reach r JOIN link l ON r.image_id = l.image_id AND r.y = l.x), lead AS (SELECT image_id, x AS cell, min(y) AS lead FROM reach GROUP BY ALL),
t AS (SELECT a.image_id, a.cell, a.score, min(lead) AS lead FROM c a JOIN k b ON {_NEXT} JOIN lead ON lead.image_id = b.image_id AND lead.cell = b.cell GROUP BY ALL),
n AS (SELECT *, dense_rank() OVER (PARTITION BY image_id ORDER BY lead) - 1 AS cluster_id FROM t)
SELECT image_id, cluster_id, max(score) AS score, count(*) AS size FROM n GROUP BY ALL HAVING count(*) BETWEEN 2 AND 60""")
def dbscan(spark, sf):
    return clusters.cluster_table(clusters.grid_dbscan(scores(spark, sf).where("score > 0.05"), KEY, 1.5, 3), KEY, 2, 60)


@query("g4_region_grow", f"""WITH RECURSIVE {P}, {S}, {_PEAKS}, c AS (SELECT image_id, "row", col, "row" * 100 + col AS cell FROM s WHERE score >= 0.0),
link AS (SELECT a.image_id, a.cell AS x, b.cell AS y FROM c a JOIN c b ON a.image_id = b.image_id AND abs(a."row" - b."row") + abs(a.col - b.col) <= 1),
reach AS (SELECT image_id, x, y FROM link UNION SELECT r.image_id, r.x, l.y FROM reach r JOIN link l ON r.image_id = l.image_id AND r.y = l.x)
SELECT image_id, CAST(x // 100 AS INT) AS peak_row, CAST(x % 100 AS INT) AS peak_col, CAST(y // 100 AS INT) AS "row", CAST(y % 100 AS INT) AS col FROM reach JOIN pk USING (image_id) WHERE x = pk."row" * 100 + pk.col""")
def region_grow(spark, sf):
    s = scores(spark, sf)
    return clusters.region_grow(s, scoremaps.peaks(s, KEY, 3, 0.05), KEY, 0.0)


def _masks(spark, sf):
    p = patches(spark, sf)
    a = p.select("image_id", F.col("label").cast("long").alias("a"), "row", "col")
    b = p.withColumn("row", (F.col("row") + 1) % 10).select("image_id", (F.col("label") + 10).cast("long").alias("b"), "row", "col")
    return a, b


_PAIRS = """a AS (SELECT image_id, CAST(label AS BIGINT) AS a, "row", col FROM p), b AS (SELECT image_id, CAST(label + 10 AS BIGINT) AS b, ("row" + 1) % 10 AS "row", col FROM p), i AS (SELECT image_id, a, b, count(*) AS n FROM a JOIN b USING (image_id, "row", col) GROUP BY ALL)"""


def _kept_sql(iou: str, over: str) -> str:
    """Masks kept in order of size, then id, that overlap (``over``) no kept one."""
    return f"""WITH RECURSIVE {P}, {_PAIRS}, na AS (SELECT image_id, a, count(*) AS n FROM a GROUP BY ALL), nb AS (SELECT image_id, b, count(*) AS n FROM b GROUP BY ALL),
x AS (SELECT i.image_id, i.a, i.b, {iou} AS iou FROM i JOIN na ON na.image_id = i.image_id AND na.a = i.a JOIN nb ON nb.image_id = i.image_id AND nb.b = i.b), two AS (SELECT image_id, a AS id, b AS other FROM x WHERE {over} UNION ALL SELECT image_id, b, a FROM x WHERE {over}),
near AS (SELECT image_id, id, list(other) AS near FROM two GROUP BY ALL), every AS (SELECT image_id, a AS id, n FROM na UNION ALL SELECT image_id, b, n FROM nb),
o AS (SELECT every.image_id, every.id, coalesce(near, []) AS near, row_number() OVER (PARTITION BY every.image_id ORDER BY n DESC, every.id) AS k FROM every LEFT JOIN near ON near.image_id = every.image_id AND near.id = every.id),
m AS (SELECT DISTINCT image_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept FROM o UNION ALL SELECT m.image_id, o.k, CASE WHEN list_has_any(m.kept, o.near) THEN m.kept ELSE list_append(m.kept, o.id) END FROM m JOIN o ON o.image_id = m.image_id AND o.k = m.k + 1)
SELECT image_id, unnest(arg_max(kept, k)) AS mask_id FROM m GROUP BY image_id"""


@query("d9_greedy_nms", _kept_sql("i.n / (na.n + nb.n - i.n)", "iou >= 0.1"))
def nms(spark, sf):
    a, b = _masks(spark, sf)
    pairs = masks.mask_iou(a, b, KEY, "a", "b", nms=True)
    every = a.select("image_id", F.col("a").alias("mask_id")).unionByName(b.select("image_id", F.col("b").alias("mask_id"))).groupBy("image_id", "mask_id").agg(F.count("*").cast("double").alias("score"))
    return clusters.greedy_nms(every, pairs, KEY, 0.1)


@query("g6_merge_overlapping", _kept_sql("i.n / (na.n + nb.n - i.n + 1e-8)", "iou > 0"))
def merge(spark, sf):
    a, b = _masks(spark, sf)
    every = a.select("image_id", F.col("a").alias("mask_id")).unionByName(b.select("image_id", F.col("b").alias("mask_id"))).groupBy("image_id", "mask_id").agg(F.count("*").cast("double").alias("score"))
    return clusters.merge_overlapping(every, masks.mask_iou(a, b, KEY, "a", "b"), KEY)


def match_sql(predicted: str = "true", truth: str = "true") -> str:
    """CTEs of the greedy match (m: image_id, a, b, iou), of predictions (na) and truths (nb); starts with WITH RECURSIVE."""
    return f"""WITH RECURSIVE {P}, {_PAIRS}, na AS (SELECT image_id, a, count(*) AS n FROM a WHERE {predicted} GROUP BY ALL), nb AS (SELECT image_id, b, count(*) AS n FROM b WHERE {truth} GROUP BY ALL),
x AS (SELECT i.image_id, i.a, i.b, i.n / (na.n + nb.n - i.n + 1e-8) AS iou FROM i JOIN na ON na.image_id = i.image_id AND na.a = i.a JOIN nb ON nb.image_id = i.image_id AND nb.b = i.b),
cand AS (SELECT image_id, a, list({{'b': b, 'iou': iou}} ORDER BY iou DESC, b) AS c FROM x GROUP BY ALL),
o AS (SELECT na.image_id, na.a, coalesce(c, []) AS c, row_number() OVER (PARTITION BY na.image_id ORDER BY n DESC, na.a) AS k FROM na LEFT JOIN cand ON cand.image_id = na.image_id AND cand.a = na.a),
steps AS (SELECT DISTINCT image_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used, NULL::BIGINT AS a, NULL::BIGINT AS b, NULL::DOUBLE AS iou FROM na
UNION ALL SELECT image_id, k, CASE WHEN y.iou >= 0.1 THEN list_append(used, y.b) ELSE used END, a, CASE WHEN y.iou >= 0.1 THEN y.b END, CASE WHEN y.iou >= 0.1 THEN y.iou END
FROM (SELECT steps.image_id, o.k, used, o.a, list_filter(o.c, lambda z: NOT list_contains(used, z.b))[1] AS y FROM steps JOIN o ON o.image_id = steps.image_id AND o.k = steps.k + 1)),
m AS (SELECT image_id, a, b, iou FROM steps WHERE b IS NOT NULL)"""


def matched(spark, sf, predicted="true", truth="true"):
    """The greedy match, the predictions and the truths."""
    a, b = _masks(spark, sf)
    a, b = a.where(predicted), b.where(truth)
    pairs = masks.mask_iou(a, b, KEY, "a", "b").select("image_id", F.col("a").alias("pred_id"), F.col("b").alias("gt_id"), "iou")
    p = a.groupBy("image_id", F.col("a").alias("pred_id")).agg(F.count("*").alias("score"))
    t = b.select("image_id", F.col("b").alias("gt_id")).distinct()
    return clusters.greedy_match(p, t, pairs, KEY, 0.1), p, t


@query("g5_greedy_match", f"{match_sql()} SELECT image_id, a AS pred_id, b AS gt_id, round(iou, 6) AS iou FROM m")
def greedy_match(spark, sf):
    return matched(spark, sf)[0].withColumn("iou", F.round("iou", 6))


@query("h19_cluster_reject", f"""WITH RECURSIVE {P}, {S}, {_COMP}, t AS (SELECT p.image_id, lead AS first_cell, e FROM c0 JOIN lead USING (image_id, cell) JOIN p ON p.image_id = c0.image_id AND p."row" = c0."row" AND p.col = c0.col), m AS ({mean_sql("t", "image_id, first_cell")}), z AS (SELECT e FROM ({mean_sql("p", "class")}) WHERE class = 'class_3')
SELECT image_id, first_cell, round({cos_sql("m.e", "z.e")}, 6) AS score FROM m, z""")
def cluster_reject(spark, sf):
    p = patches(spark, sf)
    c = clusters.connected_components(scores(spark, sf).where("score > 0.0"), KEY)
    first = c.groupBy("image_id", "cluster_id").agg(F.min(F.col("row") * 100 + F.col("col")).alias("first_cell"))
    z = proto.label_prototypes(p, ["class_3"]).select("embedding")
    out = clusters.cluster_reject(c, p.select("image_id", "row", "col", "embedding"), z, KEY)
    return out.join(first, ["image_id", "cluster_id"]).select("image_id", "first_cell", r6("score"))


@query("h19_reject_cutoff", f"""WITH {P}, {S}, a AS (SELECT split, min(score) FILTER (truth) AS g, max(score) FILTER (NOT truth) AS b, min(score) AS m FROM s GROUP BY split)
SELECT split, round(CASE WHEN g IS NULL THEN m - 1e-3 ELSE greatest(g - 0.2 * abs(g), coalesce(b + 1e-3, g - 0.2 * abs(g))) END, 6) AS cutoff FROM a""")
def reject_cutoff(spark, sf):
    return clusters.reject_cutoff(scores(spark, sf), ["split"], "truth").select("split", r6("cutoff"))


@query("h20_density_detect", f"""WITH {P}, pr AS ({mean_sql("p", "class")}), s AS (SELECT image_id, "row", col, greatest(avg({cos_sql("p.e", "pr.e")}) - 0.02, 0) AS score FROM p, pr WHERE pr.class IN ('class_1', 'class_2') GROUP BY image_id, "row", col),
pk AS (SELECT a.image_id, a."row", a.col, a.score FROM s a JOIN s b ON a.image_id = b.image_id AND abs(a."row" - b."row") <= 1 AND abs(a.col - b.col) <= 1 GROUP BY ALL HAVING max(b.score) = a.score AND a.score > 0)
SELECT image_id, CAST(floor((col + 0.5) * 10) AS INT) AS x, CAST(floor(("row" + 0.5) * 10) AS INT) AS y, round(score, 6) AS score FROM pk""")
def density_detect(spark, sf):
    p = patches(spark, sf)
    return detection.density_detect(p, proto.label_prototypes(p, ["class_1", "class_2"]), KEY, 0.02).withColumn("score", F.round("score", 6))


@query("h23_detection_sweep", f"""WITH {P}, {S}, d AS (SELECT image_id, t AS threshold, "row", col, greatest(score - t, 0) AS score FROM s, (VALUES (CAST(0.0 AS DOUBLE)), (0.1), (0.2)) v(t)),
pk AS (SELECT a.image_id, a.threshold, a."row", a.col FROM d a JOIN d b ON a.image_id = b.image_id AND a.threshold = b.threshold AND abs(a."row" - b."row") <= 1 AND abs(a.col - b.col) <= 1 GROUP BY a.image_id, a.threshold, a."row", a.col, a.score HAVING max(b.score) = a.score AND a.score > 0),
n AS (SELECT image_id, threshold, count(*) AS n FROM pk GROUP BY ALL) SELECT image_id, threshold, coalesce(n, 0) AS n_peaks, round(m, 6) AS max_density FROM (SELECT image_id, threshold, max(score) AS m FROM d GROUP BY ALL) LEFT JOIN n USING (image_id, threshold)""")
def detection_sweep(spark, sf):
    return detection.detection_sweep(scores(spark, sf).select("image_id", "row", "col", "score"), KEY, [0.0, 0.1, 0.2]).select("image_id", "threshold", "n_peaks", r6("max_density"))


@query("h24_peak_self_similarity", f"""WITH {P}, {S}, {_PEAKS} SELECT k.image_id, k."row" AS peak_row, k.col AS peak_col, b."row", b.col, round({cos_sql("a.e", "b.e")}, 6) AS similarity FROM pk k JOIN p a ON a.image_id = k.image_id AND a."row" = k."row" AND a.col = k.col JOIN p b ON b.image_id = k.image_id""")
def self_similarity(spark, sf):
    top = scoremaps.peaks(scores(spark, sf), KEY, 3, 0.05)
    return detection.peak_self_similarity(top, patches(spark, sf).select("image_id", "row", "col", "embedding"), KEY).withColumn("similarity", F.round("similarity", 6))


_STAGE_BOXES = f"""c0 AS (SELECT image_id, "row", col, score, "row" * 100 + col AS cell FROM s JOIN o USING (image_id) WHERE score > threshold), {_LINKS},
rg AS (SELECT c0.image_id, dense_rank() OVER (PARTITION BY c0.image_id ORDER BY lead) - 1 AS cluster_id, "row", col FROM c0 JOIN lead USING (image_id, cell)),
rb AS (SELECT image_id, cluster_id, min(col) AS c0, max(col) + 1 AS c1, min("row") AS r0, max("row") + 1 AS r1 FROM rg GROUP BY ALL),
rt AS (SELECT image_id, cluster_id, (c0 + c1) * 32.0::DOUBLE AS cx, (r0 + r1) * 32.0::DOUBLE AS cy, greatest((c1 - c0) * 64 * 1.2::DOUBLE, 64) AS w, greatest((r1 - r0) * 64 * 1.2::DOUBLE, 64) AS h FROM rb),
px AS (SELECT image_id, cluster_id, CAST(greatest(trunc(cx - w / 2), 0) AS INT) AS px0, CAST(greatest(trunc(cy - h / 2), 0) AS INT) AS py0, CAST(least(trunc(cx + w / 2), 640) AS INT) AS px1, CAST(least(trunc(cy + h / 2), 640) AS INT) AS py1 FROM rt)"""
#: Crop cells: a 4 x 4 grid in each box, with the vector of the patch under the cell's centre.
_CROP = f"""cr AS (SELECT image_id, cluster_id, CAST(i AS INT) AS crow, CAST(j AS INT) AS ccol, px0 + (j + 0.5::DOUBLE) * (px1 - px0) / 4 AS x, py0 + (i + 0.5::DOUBLE) * (py1 - py0) / 4 AS y FROM px, range(4) a(i), range(4) b(j)),
zc AS (SELECT e FROM ({mean_sql("p", "class")}) WHERE class = 'class_3'), fc AS (SELECT cr.*, p.e, {cos_sql("p.e", "zc.e")} AS fine FROM cr JOIN p ON p.image_id = cr.image_id AND p."row" = CAST(floor(cr.y / 64) AS INT) AND p.col = CAST(floor(cr.x / 64) AS INT), zc)"""


def _crops(spark, sf):
    """The plugged embedder of the queries: crop cells with the vectors of the patches below their centres."""
    p = patches(spark, sf)

    def embed(boxes):
        four = F.sequence(F.lit(0), F.lit(3))
        cells = boxes.withColumn("crow", F.explode(four)).withColumn("ccol", F.explode(four))
        at = lambda a, b, k: F.col(a) + (F.col(k) + 0.5) * (F.col(b) - F.col(a)) / 4
        cells = cells.withColumns({"x": at("px0", "px1", "ccol"), "y": at("py0", "py1", "crow")}).withColumns({"row": F.floor(F.col("y") / 64).cast("int"), "col": F.floor(F.col("x") / 64).cast("int"), "cell": F.col("crow") * 4 + F.col("ccol")})
        return cells.join(p.select("image_id", "row", "col", "embedding"), ["image_id", "row", "col"]).select("image_id", "cluster_id", "cell", "crow", "ccol", "x", "y", "embedding")

    return embed, proto.label_prototypes(p, ["class_3"]).select("embedding")


@query("h21_two_stage_detect", f"""WITH RECURSIVE {P}, {S}, {_OTSU}, {_STAGE_BOXES}, {_CROP}, fm AS (SELECT image_id, CAST(floor(y / 64) AS INT) AS "row", CAST(floor(x / 64) AS INT) AS col, max(fine) AS fine FROM fc GROUP BY ALL)
SELECT image_id, "row", col, round(greatest(score, coalesce(fine, score)), 6) AS score FROM s LEFT JOIN fm USING (image_id, "row", col)""")
def two_stage_detect(spark, sf):
    embed, prototype = _crops(spark, sf)
    out = detection.two_stage_detect(scores(spark, sf).select("image_id", "row", "col", "score"), embed, prototype, KEY, "otsu", None, 0.1, 64, 10, 640)
    return out.select("image_id", "row", "col", r6("score"))


@query("h21_two_stage_clusters")
def two_stage_clusters(spark, sf):
    embed, prototype = _crops(spark, sf)
    cells = embed(detection.two_stage_boxes(scores(spark, sf), KEY, "otsu", None, 0.1, 64, 10, 640))
    scored = proto.score_prototypes(cells, prototype, ["image_id", "cluster_id", "cell"])
    cells = cells.join(scored, ["image_id", "cluster_id", "cell"]).withColumnsRenamed({"crow": "row", "ccol": "col"})
    return detection.two_stage_clusters(cells, prototype, KEY, 0.05, 0.1, 10, 640)


@query("h21_two_stage_boxes", f"WITH RECURSIVE {P}, {S}, {_OTSU}, {_STAGE_BOXES} SELECT image_id, cluster_id, px0, py0, px1, py1 FROM px WHERE px1 - px0 >= 2 AND py1 - py0 >= 2")
def two_stage_boxes(spark, sf):
    return detection.two_stage_boxes(scores(spark, sf), KEY, "otsu", None, 0.1, 64, 10, 640)


@query("b18_density_crop_box", f"""WITH {P}, {S}, b AS (SELECT image_id, min(col) FILTER (score > 0.1) AS a, min("row") FILTER (score > 0.1) AS b, max(col) FILTER (score > 0.1) AS c, max("row") FILTER (score > 0.1) AS d FROM s GROUP BY image_id)
SELECT image_id, CAST(coalesce(greatest((a - 1) * 64, 0), 0) AS INT) AS x0, CAST(coalesce(greatest((b - 1) * 48, 0), 0) AS INT) AS y0, CAST(coalesce(least((c + 2) * 64, 640), 640) AS INT) AS x1, CAST(coalesce(least((d + 2) * 48, 480), 480) AS INT) AS y1 FROM b""")
def density_crop_box(spark, sf):
    from ..functions.geometry import density_crop_box as box

    return box(scores(spark, sf).withColumn("d", F.col("score") - 0.1), KEY, "d", 10, 10, 480, 640, 1)


@query("e25_seam_stats", f"""WITH {P}, n AS (SELECT a.image_id, a.col, round({cos_sql("a.e", "b.e")}, 6) AS s FROM p a JOIN p b ON a.image_id = b.image_id AND a."row" = b."row" AND b.col = a.col + 1 WHERE a.col < 8)
SELECT image_id, round(avg(s) FILTER ((col + 1) % 5 = 0), 6) AS seam_mean, round(stddev_pop(s) FILTER ((col + 1) % 5 = 0), 6) AS seam_std, count(*) FILTER ((col + 1) % 5 = 0) AS seam_n,
round(avg(s) FILTER ((col + 1) % 5 <> 0 AND col % 5 <> 0), 6) AS within_mean, round(stddev_pop(s) FILTER ((col + 1) % 5 <> 0 AND col % 5 <> 0), 6) AS within_std, count(*) FILTER ((col + 1) % 5 <> 0 AND col % 5 <> 0) AS within_n FROM n GROUP BY image_id""")
def seam_stats(spark, sf):
    n = masks.neighbour_similarity(patches(spark, sf), KEY, "col", cosine).withColumn("similarity", F.round("similarity", 6))
    out = reports.seam_stats(n, KEY, "col", 5, 8)
    return out.select("image_id", *[c if c.endswith("_n") else r6(c) for c in out.columns[1:]])


@query("e26_mean_pairwise_similarity", f"""WITH {P} SELECT a.image_id, CAST(count(DISTINCT a.vec_id) AS INT) AS n, round(avg(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)))), 6) AS mean_similarity FROM p a LEFT JOIN p b ON a.image_id = b.image_id AND a.vec_id <> b.vec_id GROUP BY a.image_id""")
def pairwise(spark, sf):
    return reports.mean_pairwise_similarity(patches(spark, sf), KEY).select("image_id", F.col("n").cast("int").alias("n"), r6("mean_similarity"))


@query("e26_map_stats", f"WITH {P}, {S} SELECT image_id, max(score) AS max, count(*) FILTER (score <> 0) AS nonzero FROM s GROUP BY image_id")
def map_stats(spark, sf):
    return reports.map_stats(scores(spark, sf), KEY)


@query("e31_cross_score", f"""WITH {P}, t AS (SELECT image_id AS crop, 'class_' || k AS scale, label = k AS truth, p.e, z.e AS z FROM p, (SELECT class, e FROM ({mean_sql("p", "class")})) z, range(3) r(k) WHERE z.class = 'class_' || k)
SELECT crop, scale, round(count(*) FILTER (s > 0.1 AND truth) / (count(*) FILTER (s > 0.1 OR truth) + 1e-8), 6) AS iou, bool_or(truth) AS gt_present FROM (SELECT crop, scale, truth, round({cos_sql("t.e", "t.z")}, 6) AS s FROM t) GROUP BY ALL""")
def cross_score(spark, sf):
    p = patches(spark, sf)
    s = proto.score_prototypes(p, proto.label_prototypes(p, ["class_0", "class_1", "class_2"]), ["image_id", "row", "col", "labels"], "max", ["label"])
    rows = s.select(F.col("image_id").alias("crop"), F.col("label").alias("scale"), F.round("score", 6).alias("score"), F.array_contains("labels", F.col("label")).alias("truth"))
    tuned = spark.createDataFrame([(f"class_{k}", 0.1) for k in range(3)], "scale string, threshold double")
    return reports.cross_score(rows, tuned).withColumn("iou", F.round("iou", 6))


@query("h18_cluster_tokens")
def cluster_tokens(spark, sf):
    return clusters.cluster_counts(clusters.cluster_tokens(patches(spark, sf), KEY, "average", threshold=0.9), KEY)


_TOKENS = """u AS (SELECT image_id, "row" * 100 + col AS cell, list_transform(e, lambda x: x / greatest(sqrt(list_dot_product(e, e)), 1e-12)) AS u FROM p),
near AS (SELECT a.image_id, a.cell AS x, b.cell AS y, 1 - list_dot_product(a.u, b.u) AS d FROM u a JOIN u b ON a.image_id = b.image_id)"""
_REACH = "reach AS (SELECT image_id, x, y FROM link UNION SELECT r.image_id, r.x, l.y FROM reach r JOIN link l ON r.image_id = l.image_id AND r.y = l.x), lead AS (SELECT image_id, x AS cell, min(y) AS lead FROM reach GROUP BY ALL)"


@query("h18_cluster_tokens_single", f"""WITH RECURSIVE {P}, {_TOKENS}, link AS (SELECT image_id, x, y FROM near WHERE d <= 0.72 OR x = y), {_REACH}
SELECT image_id, CAST(cell // 100 AS INT) AS "row", CAST(cell % 100 AS INT) AS col, dense_rank() OVER (PARTITION BY image_id ORDER BY lead) - 1 AS cluster FROM lead""")
def cluster_tokens_single(spark, sf):
    return clusters.cluster_tokens(patches(spark, sf), KEY, "single", threshold=0.72).select("image_id", "row", "col", "cluster")


@query("h18_cluster_tokens_dbscan", f"""WITH RECURSIVE {P}, {_TOKENS}, k AS (SELECT image_id, x AS cell FROM near WHERE d <= 0.75 GROUP BY ALL HAVING count(*) >= 3),
link AS (SELECT n.image_id, x, y FROM near n JOIN k a ON a.image_id = n.image_id AND a.cell = n.x JOIN k b ON b.image_id = n.image_id AND b.cell = n.y WHERE d <= 0.75), {_REACH},
t AS (SELECT n.image_id, n.x AS cell, min(lead) AS lead FROM near n JOIN lead ON lead.image_id = n.image_id AND lead.cell = n.y WHERE d <= 0.75 GROUP BY ALL), r AS (SELECT *, dense_rank() OVER (PARTITION BY image_id ORDER BY lead) - 1 AS cluster FROM t)
SELECT u.image_id, CAST(u.cell // 100 AS INT) AS "row", CAST(u.cell % 100 AS INT) AS col, coalesce(cluster, -1) AS cluster FROM u LEFT JOIN r ON r.image_id = u.image_id AND r.cell = u.cell""")
def cluster_tokens_dbscan(spark, sf):
    return clusters.cluster_tokens(patches(spark, sf), KEY, "dbscan", eps=0.75, min_samples=3).select("image_id", "row", "col", "cluster")


@query("h18_cluster_tokens_complete")
def cluster_tokens_complete(spark, sf):
    return clusters.cluster_counts(clusters.cluster_tokens(patches(spark, sf), KEY, "complete", threshold=0.95), KEY)


@query("h18_cluster_tokens_spectral")
def cluster_tokens_spectral(spark, sf):
    return clusters.cluster_tokens(patches(spark, sf), KEY, "spectral", k=5).select("image_id", "row", "col", "cluster")


@query("h12_pca_foreground")
def pca_foreground(spark, sf):
    from ..operators.subspace import pca_foreground as run

    return run(patches(spark, sf), KEY).select("image_id", "row", "col", "foreground")


@query("h13_pca_project")
def pca_project(spark, sf):
    from ..operators.subspace import fit_subspace, project

    p = patches(spark, sf)
    mean, v, _ = fit_subspace(p.where("split = 'train'"), 3)
    return project(p.select("vec_id", "embedding"), mean, v, normalise=True).select("vec_id", rounded("projection", 4).alias("projection"))


@query("h13_pca_norms", f"""WITH {P}, u AS (SELECT vec_id, split, list_transform(e, lambda x: x / greatest(sqrt(list_dot_product(e, e)), 1e-12)) AS u FROM p), d AS (SELECT vec_id, split, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM u),
m AS (SELECT i, avg(x) AS m FROM d WHERE split = 'train' GROUP BY i) SELECT vec_id, round(sum((x - m) * (x - m)), 6) AS norm FROM d JOIN m USING (i) GROUP BY vec_id""")
def pca_norms(spark, sf):
    """A projection on all directions keeps each row's distance to the mean: the directions are orthonormal and whole."""
    from ..operators.subspace import fit_subspace, project

    p = patches(spark, sf)
    width = p.select(F.max(F.size("embedding"))).head()[0]
    mean, v, _ = fit_subspace(p.where("split = 'train'"), width)
    rows = project(p.select("vec_id", "embedding"), mean, v, normalise=True)
    return rows.select("vec_id", F.round(F.aggregate("projection", F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm"))


@query("h14_whitened_covariance", "SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS covariance FROM range(8) a(i), range(8) b(j)")
def whitened_covariance(spark, sf):
    """Projections over the root of their variances have the unit covariance over the rows that they were fitted to."""
    import numpy as np

    from ..operators.subspace import fit_subspace, project

    p = patches(spark, sf).select("vec_id", "embedding")
    mean, v, variance = fit_subspace(p, 8, normalise=False)
    rows = project(p, mean, v / np.sqrt(variance)[:, None]).select("vec_id", F.posexplode("projection").alias("i", "x"))
    pairs = rows.join(rows.select("vec_id", F.col("i").alias("j"), F.col("x").alias("y")), "vec_id")  # 8 x 8 a row
    return pairs.groupBy("i", "j").agg((F.round(F.avg(F.col("x") * F.col("y")), 6) + 0.0).alias("covariance"))


@query("h14_whiten")
def whiten(spark, sf):
    from ..operators.subspace import fit_subspace
    from ..operators.subspace import whiten as run

    p = patches(spark, sf)
    return run(p.select("vec_id", "embedding"), *fit_subspace(p, 8, normalise=False)).select("vec_id", rounded("embedding", 4).alias("embedding"))


@query("h15_fgbg_classifier")
def fgbg_classifier(spark, sf):
    from ..operators.subspace import fgbg_classifier as run

    p = patches(spark, sf)
    return run(p.where("split = 'train'").select("embedding", (F.col("label") < 5).alias("is_fg")), p.where("split = 'test'").select("vec_id", "embedding")).select("vec_id", F.round("score", 4).alias("score"))


@query("g16_upsample_map", f"""WITH {P}, {S}, t AS (SELECT DISTINCT image_id, CAST(r AS INT) AS "row", CAST(c AS INT) AS col, least(greatest((r + 0.5::DOUBLE) / 3 - 0.5, 0), 9) AS y, least(greatest((c + 0.5::DOUBLE) / 3 - 0.5, 0), 9) AS x FROM s, range(30) a(r), range(30) b(c))
SELECT t.image_id, t."row", t.col, round(sum(coalesce(score, 0) * (CASE dy WHEN 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE dx WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END)), 6) AS score
FROM (SELECT * FROM t, range(2) d(dy), range(2) e(dx)) t LEFT JOIN s ON s.image_id = t.image_id AND s."row" = least(floor(y) + dy, 9) AND s.col = least(floor(x) + dx, 9) GROUP BY ALL""")
def upsample(spark, sf):
    return scoremaps.upsample_map(scores(spark, sf).select("image_id", "row", "col", "score"), KEY, 10, 10, 30, 30).withColumn("score", F.round("score", 6))
