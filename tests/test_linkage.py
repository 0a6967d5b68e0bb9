"""Token clusters against naive loops, and the registered queries' rows against them."""

import time

import numpy as np
import pytest

from gridsift.functions import blocks
from gridsift.operators import clusters, prototypes
from gridsift.plans.projection import patches


def naive(d, method, threshold=None, k=None):
    """Merge the nearest pair of clusters again and again."""
    groups = [[i] for i in range(len(d))]
    far = {"single": np.min, "complete": np.max, "average": np.mean}[method]
    while len(groups) > (k or 1):
        h, a, b = min((far(d[np.ix_(x, y)]), a, b) for a, x in enumerate(groups) for b, y in enumerate(groups) if a < b)
        if threshold is not None and h > threshold:
            break
        groups[a] += groups.pop(b)
    label = np.empty(len(d), int)
    for c, g in enumerate(sorted(groups, key=min)):
        label[g] = c
    return label.tolist()


@pytest.mark.parametrize("method", ["single", "complete", "average"])
def test_linkage_is_that_of_a_plain_loop(method):
    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 30):
        x = blocks.unit_rows(rng.normal(size=(n, 4)))
        d = 1 - x @ x.T
        for options in ({"threshold": 0.3}, {"threshold": 1.1}, {"threshold": -1.0}, {"k": 3}, {"k": 1}):
            assert blocks.linkage_labels(d, method, **options).tolist() == naive(d, method, **options)


def test_linkage_of_many_tokens_is_quadratic():
    x = blocks.unit_rows(np.random.default_rng(1).normal(size=(4096, 8)))
    began = time.time()
    label = blocks.linkage_labels(1 - x @ x.T, "average", threshold=0.4)
    assert time.time() - began < 30 and 1 < label.max() < 4095


def test_spectral_labels_find_planted_groups():
    rng = np.random.default_rng(2)
    centres = blocks.unit_rows(rng.normal(size=(4, 16)))
    of = rng.integers(0, 4, 200)
    x = blocks.unit_rows(centres[of] + 0.05 * rng.normal(size=(200, 16)))
    label = blocks.spectral_labels(x, 4, 8)
    assert len(set(zip(of, label))) == 4 and label[0] == 0 and (label == blocks.spectral_labels(x, 4, 8)).all()
    assert blocks.spectral_labels(x[:3], 5, 2).tolist() == [0, 1, 2]


def test_queries_of_token_clusters(spark, sf):
    p = patches(spark, sf)
    rows = {}
    for r in p.select("image_id", "row", "col", "embedding").collect():
        rows.setdefault(r.image_id, []).append(r)
    for method, options in (("average", {"threshold": 0.9}), ("complete", {"threshold": 0.95}), ("average", {"k": 7})):
        want = {}
        for image, r in list(rows.items())[:2]:
            r = sorted(r, key=lambda r: (r.row, r.col))
            x = blocks.unit_rows(np.array([v.embedding for v in r]))
            for v, c in zip(r, naive(np.clip(1 - x @ x.T, 0, 2), method, **options), strict=True):
                want[image, v.row, v.col] = c
        got = {(r.image_id, r.row, r.col): r.cluster for r in clusters.cluster_tokens(p, ["image_id"], method, **options).collect()}
        assert {k: v for k, v in got.items() if k in want} == want and len(got) == p.count()
    spectral = clusters.cluster_tokens(p, ["image_id"], "spectral", k=5).collect()
    assert len(spectral) == p.count() and {r.cluster for r in spectral} == set(range(5))


def test_query_of_exemplar_clusters(spark, sf):
    p = patches(spark, sf).where("image_id IN ('0', '3')")
    got = {}
    for r in prototypes.exemplar_clusters(p.selectExpr("image_id AS exemplar_id", "vec_id AS pos", "embedding"), 4).collect():
        got[r.exemplar_id, r.k] = r.embedding
    for image in ("0", "3"):
        x = blocks.unit_rows(np.array([r.embedding for r in p.where(f"image_id = '{image}'").orderBy("vec_id").collect()]))
        label = np.array(naive(1 - x @ x.T, "average", k=4))
        for c in range(4):
            m = x[label == c].mean(0)
            assert np.allclose(got[image, c], m / np.linalg.norm(m))
