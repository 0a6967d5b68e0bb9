"""Queries of ranking and detection metrics and of reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, reports, retrieval
from .projection import table
from .registry import query
from .scoremap_queries import match_sql, matched


def r6(c):
    return F.round(c, 6).alias(c)


def _lineitem(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("method"), F.col("l_extendedprice").alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("target"))


_L = "l AS (SELECT l_linestatus AS method, l_extendedprice AS score, CAST(l_returnflag = 'R' AS INT) AS target FROM lineitem)"
_D = "d AS (SELECT lang AS method, CAST(n_chars AS DOUBLE) AS score, quality AS target FROM documents JOIN labels USING (doc_id))"


def _run(src: str) -> str:
    return f"""g AS (SELECT method, score, sum(target) AS t, sum(1 - target) AS f FROM {src} GROUP BY ALL),
r AS (SELECT *, sum(t) OVER u AS tp, sum(f) OVER u AS fp, sum(t) OVER w AS p, sum(f) OVER w AS n FROM g WINDOW u AS (PARTITION BY method ORDER BY score DESC), w AS (PARTITION BY method))"""


_RANK = """SELECT method, round(sum(f * (tp - t + t / 2)) / (nullif(max(p), 0) * nullif(max(n), 0)), 6) AS auroc,
round(sum(t * (CASE WHEN tp - t + fp - f > 0 THEN (tp - t) / (tp - t + fp - f) ELSE tp / (tp + fp) END + tp / (tp + fp)) / 2) / nullif(max(p), 0), 6) AS aupr, CASE WHEN max(p) > 0 THEN round(max(2 * tp / (tp + fp + p)), 6) END AS f1max FROM r GROUP BY method"""


def _documents(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(F.col("lang").alias("method"), F.col("n_chars").cast("double").alias("score"), F.col("quality").alias("target"))


@query("e20_image_ranking_metrics", f"WITH {_D}, {_run('d')} {_RANK}")
def image_metrics(spark, sf):
    return metrics.ranking_metrics(_documents(spark, sf), ["method"]).select("method", r6("auroc"), r6("aupr"), r6("f1max"))


@query("e21_pixel_ranking_metrics", f"WITH {_L}, {_run('l')} {_RANK}")
def pixel_metrics(spark, sf):
    return metrics.ranking_metrics(_lineitem(spark, sf), ["method"]).select("method", r6("auroc"), r6("aupr"), r6("f1max"))


@query("g12_roc_auc", f"WITH {_L}, {_run('l')}, c AS (SELECT method, fp / n AS x, tp / p AS y FROM r), q AS (SELECT method, x, y, lag(x) OVER w AS x0, lag(y) OVER w AS y0 FROM c WINDOW w AS (PARTITION BY method ORDER BY x, y)) SELECT method, round(sum((x - x0) * (y + y0) / 2), 6) AS auc FROM q WHERE x0 IS NOT NULL GROUP BY method")
def roc_auc(spark, sf):
    return metrics.auc(metrics.roc_curve(_lineitem(spark, sf), ["method"]), ["method"], "fpr", "tpr").select("method", r6("auc"))


@query("g12_average_precision", f"""WITH {_D}, {_run('d')}, n AS (SELECT method, count(*) AS n_images FROM d GROUP BY method), c AS (SELECT method, score, tp / (tp + fp) AS precision, tp / n_images AS recall FROM r JOIN n USING (method)),
q AS (SELECT method, recall, precision, coalesce(lag(recall) OVER w, 0) AS r0, coalesce(lag(precision) OVER w, 1) AS p0 FROM c WINDOW w AS (PARTITION BY method ORDER BY score DESC)) SELECT method, round(sum((recall - r0) * (precision + p0) / 2), 6) AS ap FROM q GROUP BY method""")
def average_precision(spark, sf):
    d = _documents(spark, sf)
    curve = metrics.pr_curve(d, ["method"], d.groupBy("method").agg(F.count("*").alias("n_images")))
    return metrics.average_precision(curve, ["method"]).select("method", r6("ap"))


@query("e22_aupro", """WITH x AS (SELECT l_linestatus AS method, CASE WHEN l_returnflag = 'R' THEN l_suppkey % 7 END AS region, l_extendedprice AS score FROM lineitem),
s AS (SELECT method, region, count(*) AS s FROM x WHERE region IS NOT NULL GROUP BY ALL), k AS (SELECT method, count(*) AS k FROM s GROUP BY method),
g AS (SELECT x.method, score, sum(CASE WHEN x.region IS NULL THEN 0 ELSE 1.0 / (s * CAST(k AS DOUBLE)) END) AS t, CAST(count(*) FILTER (x.region IS NULL) AS DOUBLE) AS f FROM x LEFT JOIN s ON x.method = s.method AND x.region = s.region LEFT JOIN k ON x.method = k.method GROUP BY ALL),
r AS (SELECT *, sum(t) OVER u AS y1, sum(f) OVER u AS fp, sum(f) OVER (PARTITION BY method) AS n FROM g WINDOW u AS (PARTITION BY method ORDER BY score DESC)),
c AS (SELECT method, (fp - f) / n AS x0, fp / n AS x1, y1 - t AS y0, y1, least(fp / n, 0.3) AS c FROM r)
SELECT method, round(sum(CASE WHEN x0 < 0.3 THEN (c - x0) * (y0 + y0 + (y1 - y0) * CASE WHEN x1 > x0 THEN (c - x0) / (x1 - x0) ELSE 1 END) / 2 ELSE 0 END) / 0.3, 5) AS aupro FROM c GROUP BY method""")
def aupro(spark, sf):
    x = table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("method"), F.when(F.col("l_returnflag") == "R", F.col("l_suppkey") % 7).alias("region_id"), F.col("l_extendedprice").alias("score"))
    return metrics.aupro(x, ["method"]).select("method", F.round("aupro", 5).alias("aupro"))


#: Some images without predictions, some without truths, and masks without a partner on either side.
_PRED, _TRUE = "CAST(image_id AS INT) % 4 <> 1 AND a % 3 <> 0", "CAST(image_id AS INT) % 4 <> 2 AND b % 5 <> 0"


@query("e16_match_metrics", f"""{match_sql(_PRED, _TRUE)}, np AS (SELECT image_id, count(*) AS p FROM na GROUP BY image_id), ng AS (SELECT image_id, count(*) AS g FROM nb GROUP BY image_id), nt AS (SELECT image_id, count(*) AS t, sum(iou) AS s FROM m GROUP BY image_id),
c AS (SELECT image_id, coalesce(p, 0) AS p, coalesce(g, 0) AS g, coalesce(t, 0) AS t, coalesce(s, 0) AS s FROM np FULL JOIN ng USING (image_id) LEFT JOIN nt USING (image_id)),
r AS (SELECT *, CASE WHEN p > 0 THEN t / p ELSE 0 END AS pr, CASE WHEN g > 0 THEN t / g END AS rc FROM c)
SELECT image_id, CASE WHEN g > 0 THEN round(pr, 6) END AS precision, round(rc, 6) AS recall, CASE WHEN g > 0 THEN round(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END, 6) END AS f1,
CASE WHEN g > 0 THEN round(CASE WHEN t > 0 THEN s / t ELSE 0 END, 6) END AS mean_iou, t AS tp, p - t AS fp, CASE WHEN g > 0 THEN g - t ELSE 0 END AS fn, abs(p - g) AS count_error, p AS n_pred, g AS n_gt FROM r""")
def match_metrics(spark, sf):
    m, predicted, truth = matched(spark, sf, _PRED, _TRUE)
    n = predicted.groupBy("image_id").agg(F.count("*").alias("n_pred")).join(truth.groupBy("image_id").agg(F.count("*").alias("n_gt")), "image_id", "full")
    c = n.join(m.groupBy("image_id").agg(F.count("*").alias("tp"), F.sum("iou").alias("iou_sum")), "image_id", "left").na.fill(0)
    return metrics.match_metrics(c, ["image_id"]).select("image_id", r6("precision"), r6("recall"), r6("f1"), r6("mean_iou"), "tp", "fp", "fn", "count_error", "n_pred", "n_gt")


_M = """m AS (SELECT event_type AS method, user_id, value / 100 AS precision, CASE WHEN value > 5 THEN value / 50 END AS recall, value / 200 AS f1, CASE WHEN event_id % 7 = 0 THEN CAST('nan' AS DOUBLE) ELSE value / 300 END AS mean_iou, event_id % 5 AS count_error FROM events)"""


@query("e17_method_summary", f"""WITH {_M} SELECT method, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, round(avg(CASE WHEN NOT isnan(mean_iou) THEN mean_iou END), 6) AS mean_iou, round(avg(count_error), 6) AS count_error FROM m GROUP BY method""")
def method_summary(spark, sf):
    v = F.col("value")
    m = table(spark, sf, "events").select(F.col("event_type").alias("method"), (v / 100).alias("precision"), F.when(v > 5, v / 50).alias("recall"), (v / 200).alias("f1"), F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(v / 300).alias("mean_iou"), (F.col("event_id") % 5).alias("count_error"))
    out = metrics.method_summary(m, ["view", "click"])
    return out.select("method", *[r6(c) for c in out.columns[1:]])


_CAND = "c AS (SELECT user_id AS image_id, event_id AS candidate_id, round(value, 3) AS score, event_id * 37 % 100 / 100.0 AS iou FROM events WHERE event_type <> 'error'), im AS (SELECT DISTINCT user_id AS image_id FROM events)"


def _candidates(spark, sf):
    e = table(spark, sf, "events")
    c = e.where("event_type <> 'error'").select(F.col("user_id").alias("image_id"), F.col("event_id").alias("candidate_id"), F.round("value", 3).alias("score"), (F.col("event_id") * 37 % 100 / 100).alias("iou"))
    return c, e.select(F.col("user_id").alias("image_id")).distinct()


@query("e23_instance_stats", f"""WITH {_CAND}, b AS (SELECT image_id, max(iou) FILTER (score >= 20) AS b FROM im LEFT JOIN c USING (image_id) GROUP BY image_id), n AS (SELECT count(*) FILTER (b >= 0.95) AS tp, count(*) FILTER (b < 0.95) AS fp, count(*) FILTER (b IS NULL) AS fn FROM b)
SELECT tp, fp, fn, round(tp / (tp + fn + 1e-8), 6) AS tpr, round(tp / (tp + fp + 1e-8), 6) AS precision FROM n""")
def instance_stats(spark, sf):
    return metrics.instance_stats(*_candidates(spark, sf), 20, 0.95).select("tp", "fp", "fn", r6("tpr"), r6("precision"))


@query("e24_iou_distribution", f"WITH {_CAND} SELECT image_id, round(avg(iou), 6) AS mean, round(median(iou), 6) AS median, max(iou) AS max, round(avg(CAST(iou >= 0.5 AS INT)), 6) AS share FROM c GROUP BY image_id")
def iou_distribution(spark, sf):
    out = metrics.iou_distribution(_candidates(spark, sf)[0], ["image_id"], 0.5)
    return out.select("image_id", r6("mean"), r6("median"), "max", r6("share"))


@query("e24_histogram", f"WITH {_CAND} SELECT CAST(least(floor((score - 0) / ((100.0 - 0) / 50)), 49) AS INT) AS bin, count(*) AS n FROM c WHERE score BETWEEN 0 AND 100 GROUP BY 1")
def histogram(spark, sf):
    return metrics.histogram(_candidates(spark, sf)[0], [], "score", 0, 100, 50)


@query("d8_best_candidate", f"WITH {_CAND} SELECT image_id, arg_min(candidate_id, (-score, candidate_id)) AS candidate_id, max(score) AS score, arg_min(iou, (-score, candidate_id)) AS iou, arg_min(iou, (-score, candidate_id)) >= 0.5 AS hit FROM c GROUP BY image_id")
def best_candidate(spark, sf):
    return reports.best_candidate(_candidates(spark, sf)[0], ["image_id"], 0.5)


_SC = "sc AS (SELECT lang AS category, source AS method, doc_id AS image_id, quality AS label_index, CAST(n_chars AS DOUBLE) AS image_score FROM documents JOIN labels USING (doc_id))"


def _scores(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(F.col("lang").alias("category"), F.col("source").alias("method"), F.col("doc_id").alias("image_id"), F.col("quality").alias("label_index"), F.col("n_chars").cast("double").alias("image_score"))


@query("d6_best_worst", f"""WITH {_SC}, a AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY image_score, image_id) AS w, row_number() OVER (PARTITION BY category ORDER BY image_score DESC, image_id) AS b FROM sc WHERE label_index = 1)
SELECT category, image_id, image_score, 'worst' AS side, CAST(w AS INT) AS rank FROM a WHERE w <= 3 UNION ALL SELECT category, image_id, image_score, 'best', CAST(b AS INT) FROM a WHERE b <= 3""")
def best_worst(spark, sf):
    return reports.best_worst(_scores(spark, sf), ["category"], 3)


@query("d5_top_fraction_mean", f"""WITH {_SC}, r AS (SELECT category, image_score, count(*) OVER (PARTITION BY category) AS n, row_number() OVER (PARTITION BY category ORDER BY image_score DESC) AS r FROM sc) SELECT category, round(avg(image_score), 6) AS image_score FROM r WHERE r <= greatest(1, CAST(floor(n * 0.05) AS INT)) GROUP BY category""")
def top_fraction(spark, sf):
    return retrieval.top_fraction_mean(_scores(spark, sf).withColumnRenamed("image_score", "s"), ["category"], "s", 0.05).select("category", r6("image_score"))


@query("d7_best_over_baseline", """WITH e AS (SELECT user_id AS family, event_id % 6 AS i, max(value) AS v FROM events GROUP BY ALL), b AS (SELECT family, arg_min(i, (-v, i)) AS i, max(v) AS v, max(v) FILTER (i = 0) AS z FROM e GROUP BY family)
SELECT family, i, v, round(v - z, 9) AS delta, CAST(row_number() OVER (ORDER BY v - z DESC NULLS LAST, family) AS INT) AS rank FROM b""")
def best_over_baseline(spark, sf):
    e = table(spark, sf, "events").groupBy(F.col("user_id").alias("family"), (F.col("event_id") % 6).alias("i")).agg(F.max("value").alias("v"))
    return reports.best_over_baseline(e, ["family"], "i", "v").withColumn("delta", F.round("delta", 9))


@query("c10_baseline_join", """WITH e AS (SELECT user_id AS family, event_id % 6 AS i, max(value) AS v FROM events GROUP BY ALL) SELECT e.family, e.i, e.v, b.v AS base FROM e JOIN e b ON e.family = b.family AND b.i = 0""")
def baseline_join(spark, sf):
    e = table(spark, sf, "events").groupBy(F.col("user_id").alias("family"), (F.col("event_id") % 6).alias("i")).agg(F.max("value").alias("v"))
    return reports.baseline_join(e, ["family"], "i", "v")


@query("g17_severity_fraction", """WITH e AS (SELECT user_id AS family, event_id % 6 AS i, max(value) AS v FROM events GROUP BY ALL), w AS (SELECT *, first_value(v) OVER w AS a, last_value(v) OVER w AS b FROM e WINDOW w AS (PARTITION BY family ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT family, i, round(CASE WHEN a = b THEN 0 ELSE (v - a) / (b - a) END, 6) AS fraction FROM w""")
def severity_fraction(spark, sf):
    from ..functions.geometry import severity_fraction as fraction

    e = table(spark, sf, "events").groupBy(F.col("user_id").alias("family"), (F.col("event_id") % 6).alias("i")).agg(F.max("value").alias("v"))
    return e.select("family", "i", F.round(fraction("v", ["family"], "i"), 6).alias("fraction"))


@query("d10_side_by_side", f"""WITH {_SC}, f AS (SELECT DISTINCT image_id FROM sc WHERE method = 'src1' AND label_index = 1 ORDER BY image_id LIMIT 5) SELECT image_id, max(image_score) FILTER (method = 'src1') AS src1, max(image_score) FILTER (method = 'src2') AS src2 FROM sc SEMI JOIN f USING (image_id) GROUP BY image_id""")
def side_by_side(spark, sf):
    return reports.side_by_side(_scores(spark, sf), "src1", ["src1", "src2"], 5)


@query("e18_pivot_metric", f"WITH {_SC} SELECT method, max(m) FILTER (category = 'en') AS en, max(m) FILTER (category = 'fr') AS fr FROM (SELECT method, category, round(avg(image_score), 6) AS m FROM sc GROUP BY ALL) GROUP BY method")
def pivot_metric(spark, sf):
    m = _scores(spark, sf).groupBy("method", "category").agg(F.round(F.avg("image_score"), 6).alias("m"))
    return reports.pivot_metric(m, "method", "category", "m", ["en", "fr"])


@query("e19_cross_scale_matrix", """SELECT event_type AS roi_source, round(avg(value) FILTER (event_id % 2 = 0), 6) AS even, round(avg(value) FILTER (event_id % 2 = 1), 6) AS odd FROM events WHERE value > 1 GROUP BY event_type""")
def cross_scale_matrix(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_type").alias("roi_source"), F.when(F.col("event_id") % 2 == 0, "even").otherwise("odd").alias("score_scale"), F.col("value").alias("iou"), (F.col("value") > 1).alias("gt_present"))
    return reports.cross_scale_matrix(rows, ["even", "odd"]).select("roi_source", r6("even"), r6("odd"))


@query("e27_run_summary", """WITH m AS (SELECT event_type AS method, user_id % 5 AS category, value, event_id % 3 > 0 AS test FROM events), s AS (SELECT CAST(category AS VARCHAR) AS category, method, round(avg(value), 6) AS mean_latency_ms, count(*) AS n_test FROM m WHERE test GROUP BY ALL)
SELECT *, CASE WHEN category <> '4' THEN 1.5 END AS fit_s FROM s""")
def run_summary(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") % 5).cast("string").alias("category"), F.col("event_type").alias("method"), F.when(F.col("event_id") % 3 > 0, "test").otherwise("train").alias("split"), F.col("value").alias("latency_ms"))
    meta = e.where("category <> '4'").select("category", "method").distinct().withColumn("fit_s", F.lit(1.5))
    return reports.run_summary(e, meta).select("category", "method", r6("mean_latency_ms"), "n_test", "fit_s")


@query("e28_image_pair_quality", """SELECT l_linestatus AS pair, round(avg((l_quantity - l_discount * 500) ** 2), 5) AS mse, round(covar_pop(l_quantity, l_discount * 500) / (stddev_pop(l_quantity) * stddev_pop(l_discount * 500) + 1e-12), 6) AS ncc FROM lineitem WHERE l_quantity > 0 AND l_discount * 500 > 0 GROUP BY 1""")
def image_pair_quality(spark, sf):
    x = table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("pair"), F.col("l_quantity").alias("a"), (F.col("l_discount") * 500).alias("b"))
    return metrics.image_pair_quality(x, ["pair"]).select("pair", F.round("mse", 5).alias("mse"), r6("ncc"))


@query("c12_scores_with_masks", """SELECT d.doc_id AS image_id, n_chars AS score, coalesce(quality, 0) AS gt FROM documents d LEFT JOIN labels l USING (doc_id)""")
def scores_with_masks(spark, sf):
    d, l = table(spark, sf, "documents").select(F.col("doc_id").alias("image_id"), F.col("n_chars").alias("score")), table(spark, sf, "labels").select(F.col("doc_id").alias("image_id"), "quality")
    return d.join(l, "image_id", "left").select("image_id", "score", F.coalesce("quality", F.lit(0)).alias("gt"))
