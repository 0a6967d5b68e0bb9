import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridsift.llm import classifier
from gridsift.llm.q_classifier import op6_quality_classifier
from gridsift.llm.session import table


def test_fit_finds_the_optimum():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 3))
    y = (rng.random(500) < 1 / (1 + np.exp(-(x @ [2, -1, 0] + 0.5)))).astype(float)
    w, b = classifier.fit(x, y, ridge=1e-6)
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert abs(x.T @ (y - p)).max() < 1e-3 and abs((y - p).sum()) < 1e-3
    assert classifier.fit(x, np.ones(500))[0].any() == False  # noqa: E712


def plain_posteriors(rows):
    """Rate, and p_host and p_path by host and path, of (host, path, good), with variances from deviations."""
    good, rate = np.array([r[2] for r in rows]), (sum(r[2] for r in rows) + 1) / (len(rows) + 2)

    def grouped(keys):
        by = {}
        for k, r in zip(keys, rows):
            by.setdefault(k, []).append(r[2])
        return {k: np.array(v) for k, v in by.items()}

    def weight(by, parent_of, parents):
        n, k, p = len(rows), len(by), len(parents)
        if k <= p or n <= k:
            return 1e6
        noise = sum(((v - v.mean()) ** 2).sum() for v in by.values()) / (n - k)
        between = sum(len(v) * (v.mean() - parents[parent_of(g)].mean()) ** 2 for g, v in by.items())
        spread = (between - (k - p) * noise) / (n - sum(len(v) ** 2 / len(parents[parent_of(g)]) for g, v in by.items()))
        return 1e6 if spread <= 0 else min(max(noise / spread, 2), 1e6)

    hosts, paths = grouped([r[0] for r in rows]), grouped([r[:2] for r in rows])
    wide, narrow = weight(hosts, lambda g: None, {None: good}), weight(paths, lambda g: g[0], hosts)
    p_host = {h: (v.sum() + wide * rate) / (len(v) + wide) for h, v in hosts.items()}
    return rate, p_host, {g: (v.sum() + narrow * p_host[g[0]]) / (len(v) + narrow) for g, v in paths.items()}


def test_posteriors_against_plain_python(spark):
    rng = np.random.default_rng(2)
    rows = [(f"h{i % 7}", f"p{i % 3}", float(rng.random() < 0.2 + 0.1 * (i % 7) + 0.1 * (i % 3 == i % 2))) for i in range(900)] + [("sparse", "p0", 0.0)]
    df, rate = classifier.posteriors(spark.createDataFrame(rows, "host string, path string, good double"))
    want_rate, p_host, p_path = plain_posteriors(rows)
    assert rate == pytest.approx(want_rate)
    got = df.collect()
    assert len(got) == len(p_path)
    for r in got:
        assert r.p_host == pytest.approx(p_host[r.host]) and r.p_path == pytest.approx(p_path[r.host, r.path])


def plain_features(t):
    raw = (t or "").encode()
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    w = re.findall(rb"[^\x20\x09-\x0D]+", low)
    share = lambda keep: sum(b in keep for b in raw) / max(len(raw), 1)
    n = max(len(w), 1)
    blank = sum(b in b" \t\n\x0b\x0c\r" for b in raw)
    first = [share(range(65, 91)), share(range(48, 58)), share(b"\n"), share(b"#*$%&|<>"), share(b"!?"), share(b".,;:'\"()-/")]
    lag = lambda k: sum(a == b for a, b in zip(w, w[k:])) / n
    return [*first, min((len(raw) - blank) / n, 100) / 10, np.log1p(len(w)) / 5, lag(1), lag(2), len(set(w)) / n, sum(len(x) <= 2 for x in w) / n]


def test_query_against_brute_force(spark, sf):
    docs = duckdb.sql(f"select doc_id, text, coalesce(source, ''), coalesce(lang, '') from '{sf}/documents.parquet' order by doc_id").fetchall()
    known = dict(duckdb.sql(f"select doc_id, avg(quality) from '{sf}/labels.parquet' where quality is not null group by 1").fetchall())
    x = np.array([plain_features(d[1]) for d in docs])
    use = [i for i, d in enumerate(docs) if d[0] in known]
    w, b = classifier.fit(x[use], np.array([float(known[docs[i][0]] >= 0.5) for i in use]))
    p = 1 / (1 + np.exp(-(x @ w + b)))
    rate, p_host, p_path = plain_posteriors([(d[2], d[3], known.get(d[0], p[i])) for i, d in enumerate(docs)])
    logit = lambda v: np.log(v / (1 - v))
    got = {r.doc_id: r for r in op6_quality_classifier(spark, sf).collect()}
    assert len(got) == len(docs) and len({r.kept for r in got.values()}) == 2
    for i, (d, _, h, path) in enumerate(docs):
        score = 1 / (1 + np.exp(-(logit(np.clip(p[i], 1e-12, 1 - 1e-12)) + logit(p_path[h, path]) - logit(rate))))
        assert (got[d].p_document, got[d].p_host, got[d].p_path, got[d].score) == pytest.approx((p[i], p_host[h], p_path[h, path], score), rel=1e-4)
        assert got[d].kept == (got[d].score >= 0.5)


def test_hosts_and_paths_decide_where_texts_do_not(spark):
    text = "the same plain words for every document of this table"
    rows, labels = [], []
    for host, path, n, good in (("good", "en", 60, 1), ("good", "de", 60, 1), ("bad", "en", 60, 0), ("bad", "de", 60, 0), ("split", "en", 60, 1), ("split", "de", 60, 0), ("sparse", "en", 1, 0)):
        for k in range(n + 3):
            rows.append((len(rows), text, host, path))
            if k < n:
                labels.append((len(rows) - 1, good))
    out = classifier.quality_scores(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    kept = {(r.source, r.lang): r.kept for r in out}
    assert kept["good", "en"] and kept["good", "de"] and not kept["bad", "en"] and not kept["bad", "de"] and kept["split", "en"] and not kept["split", "de"]
    p = {r.source: r.p_host for r in out}
    assert p["bad"] < p["sparse"] < p["good"]


def test_sample_is_bounded_where_rows_repeat(spark):
    rows = spark.createDataFrame([([float(i % 50)] * len(classifier.FEATURES), float(i % 2), 7 if i < 3000 else i * (1 << 50)) for i in range(6000)], "x array<double>, y double, h long")
    x, y = classifier._training_rows(rows.withColumn("h", F.xxhash64("h", "x")), 40)
    assert len(x) == len(y) <= 40 and len(classifier._training_rows(rows.limit(0), 40)[0]) == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    out = classifier.quality_scores(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    assert len(out) > 100
    good, bad = out[out.quality == 1], out[out.quality == 0]
    assert good.kept.mean() > 0.97 and bad.kept.mean() < 0.2


def test_edges(spark):
    rows = [(1, None, None, None), (1, "", "s", None), (None, "word " * 1000, None, "en"), (3, "x" * 100000, "s", "en"), (3, "x" * 100000, "s", "en")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, source string, lang string, score double")
    labels = spark.createDataFrame([(1, 1), (1, None), (9, 0), (None, 0)], "doc_id long, quality int")
    out = classifier.quality_scores(docs, labels).collect()
    assert len(out) == len(rows) and all(r.kept and 0 <= r.score <= 1 for r in out)
    assert classifier.quality_scores(docs.limit(0), labels).count() == 0
    assert all(r.kept for r in classifier.quality_scores(docs, labels.limit(0)).collect())
