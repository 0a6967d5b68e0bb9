"""The pivot index against brute force."""

import numpy as np
import pytest

from gridsift.functions import blocks
from gridsift.operators import knn, pivots


def frame(spark, name, ids, x):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], f"{name} long, v array<double>")


def brute(ids, x, bank_ids, y, k):
    s = np.round(blocks.unit_rows(x) @ blocks.unit_rows(y).T, 12)
    return sorted((int(i), r + 1, int(bank_ids[c])) for i, row in zip(ids, s, strict=True) for r, c in enumerate(sorted(range(len(bank_ids)), key=lambda c: (-row[c], bank_ids[c]))[:k]))


def rows(df):
    return sorted((r.query_id, r.rank, r.bank_id) for r in df.collect())


@pytest.mark.parametrize("seed,k,d,spread", [(1, 3, 4, 0.1), (2, 7, 16, 1.0), (3, 1, 3, 0.02)])
def test_rows_and_ties_are_those_of_brute_force(spark, seed, k, d, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    y = centres[rng.integers(0, 12, 500)] + spread * rng.normal(size=(500, d))
    y[100:240] = y[0]  # many equal rows in one cell
    y[240:250] = -y[1]
    x = np.concatenate((y[::50] * 3, centres, rng.normal(size=(20, d)), -y[:3]))
    bank_ids, ids = rng.permutation(5000)[:500], np.arange(len(x)) * 7
    q, b = frame(spark, "query_id", ids, x).repartition(3), frame(spark, "bank_id", bank_ids, y).repartition(5)
    index = pivots.build(b, 500, d, 20, 30)
    assert index.size.sum() == 500 and index.size.max() <= 60
    assert rows(pivots.nearest(q, index, k, d, 7)) == brute(ids, x, bank_ids, y, k)


def test_few_rows(spark):
    q, b = frame(spark, "query_id", [1, 2], np.eye(2)), frame(spark, "bank_id", [5, 6, 7], np.array([[1.0, 0], [0, 1], [0, 0]]))
    assert rows(pivots.nearest(q, pivots.build(b, 3, 2, 2, 1), 9, 2, 1)) == brute([1, 2], np.eye(2), [5, 6, 7], np.array([[1.0, 0], [0, 1], [0, 0]]), 9)
    assert pivots.nearest(q.limit(0), pivots.build(b, 3, 2), 2, 2).count() == 0
    assert knn.knn_join(q, b, 2, column="v", bank_bytes=0).count() == 4


def test_clustered_data_is_pruned(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 8))
    y = centres[rng.integers(0, 20, 800)] + 0.05 * rng.normal(size=(800, 8))
    q, b = frame(spark, "query_id", range(40), y[:40]), frame(spark, "bank_id", range(800), y)
    index = pivots.build(b, 800, 8, 40, 20)
    share = pivots.pairs(q, index, 3, 8).head()
    assert share["all"] == 32000 and share.compared < 0.3 * share["all"]
