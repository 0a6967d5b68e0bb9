"""Subspaces: the sketch against the exact fit, and the registered queries' rows against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridsift.functions import blocks
from gridsift.operators import subspace
from gridsift.plans import gallery_queries
from gridsift.plans.projection import patches
from gridsift.plans.registry import QUERIES

assert gallery_queries


def arrays(df, *columns):
    rows = df.collect()
    return [np.array([r[c] for r in rows]) for c in columns]


def test_sketch_spans_the_exact_subspace(spark):
    rng = np.random.default_rng(3)
    scale = 2.0 ** -np.arange(60) + 1e-3
    x = rng.normal(size=(700, 60)) * scale @ np.linalg.qr(rng.normal(size=(60, 60)))[0] + 0.3
    df = spark.createDataFrame([(v.tolist(),) for v in x], "embedding array<double>")
    mean, v, variance = subspace.fit_subspace(df, 5, normalise=False)
    for parts in (1, 4):
        m, s, sv = subspace.sketch_subspace(df.repartition(parts), 5, normalise=False)
        assert np.allclose(m, mean) and np.allclose(s @ s.T, np.eye(5), atol=1e-9) and np.allclose(sv, variance, rtol=1e-6)
        angle = np.arccos(np.clip(np.linalg.svd(v @ s.T)[1].min(), -1, 1))
        assert angle < 1e-3
    with pytest.raises(ValueError):
        subspace.sketch_subspace(df.limit(0), 2)


def test_wide_vectors_go_by_the_sketch(spark, monkeypatch):
    df = spark.createDataFrame([(np.random.default_rng(i).normal(size=60).tolist(),) for i in range(80)], "embedding array<double>")
    called = []
    monkeypatch.setattr(subspace, "sketch_subspace", lambda *a: called.append(a[1]))
    monkeypatch.setattr(subspace, "WIDE", 50)
    subspace.fit_subspace(df, 2)
    subspace.fit_subspace(df, 20)  # too many directions
    assert called == [2]


def principal(x, k):
    mean = x.mean(0)
    value, vector = np.linalg.eigh((x - mean).T @ (x - mean) / len(x))
    v = vector[:, ::-1][:, :k].T
    return mean, v * np.sign(v[np.arange(k), np.abs(v).argmax(1)])[:, None], value[::-1][:k]


def test_rows_of_the_pca_queries(spark, sf):
    p = patches(spark, sf).orderBy("vec_id")
    ids, x, split = arrays(p, "vec_id", "embedding", "split")
    u = blocks.unit_rows(x)
    mean, v, _ = principal(u[split == "train"], 3)
    i, got = arrays(QUERIES["h13_pca_project"](spark, sf).orderBy("vec_id"), "vec_id", "projection")
    assert (i == ids).all() and np.allclose(got, (u - mean) @ v.T, atol=2e-4)
    mean, v, variance = principal(x, 8)
    _, got = arrays(QUERIES["h14_whiten"](spark, sf).orderBy("vec_id"), "vec_id", "embedding")
    assert np.allclose(got, blocks.unit_rows((x - mean) @ v.T / np.sqrt(variance + 1e-6)), atol=2e-4)
    image, row, col, fg = arrays(QUERIES["h12_pca_foreground"](spark, sf).orderBy(F.col("image_id").cast("int"), "row", "col"), "image_id", "row", "col", "foreground")
    want = []
    for k in range(len(x) // 100):
        own = x[100 * k : 100 * k + 100]
        mean, v, _ = principal(own, 1)
        want.append((own - mean) @ v[0])
    want = np.concatenate(want)
    assert (image.astype(int) * 100 + row * 10 + col == ids).all() and (fg == (want > 0))[np.abs(want) > 1e-9].all()


def test_rows_of_the_fitted_queries(spark, sf):
    p = patches(spark, sf)
    got = {r.vec_id: r.cluster for r in QUERIES["h10_kmeans_cosine"](spark, sf).collect()}
    ids, x = arrays(p, "vec_id", "embedding")
    u = blocks.unit_rows(x)
    label = np.array([got[i] for i in ids])
    assert len(got) == len(ids) and set(label) <= set(range(4))
    centres = blocks.unit_rows(np.array([u[label == c].mean(0) for c in sorted(set(label))]))
    assert (u @ centres.T)[np.arange(len(u)), np.searchsorted(sorted(set(label)), label)].mean() > (u @ blocks.unit_rows(u.mean(0)[None]).T).mean()
    score = {r.vec_id: r.score for r in QUERIES["h15_fgbg_classifier"](spark, sf).collect()}
    test = {r.vec_id: r.label < 5 for r in p.where("split = 'test'").collect()}
    assert score.keys() == test.keys() and all(0 <= s <= 1 for s in score.values())
    train = p.where("split = 'train'").select("vec_id", "embedding", (F.col("label") < 5).alias("is_fg"))
    fitted = {r.vec_id: (r.score > 0.5) == r.is_fg for r in subspace.fgbg_classifier(train, train).collect()}
    assert np.mean(list(fitted.values())) > 0.8  # it learns what it was given
