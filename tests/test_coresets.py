"""Composable core-sets against the plain greedy choice."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridsift.functions import blocks
from gridsift.operators import coresets
from gridsift.plans.projection import patches


def bank_of(spark, x, ids):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "bank_id long, embedding array<double>")


def plain(x, ids, n):
    """The greedy choice by a plain loop: ids, and the largest cosine distance that is left."""
    order = np.argsort(ids)
    u, ids = blocks.unit_rows(x[order]), ids[order]
    chosen, far = [0], np.round(1 - u @ u[0], 12)
    while len(chosen) < min(n, len(u)):
        chosen.append(min((i for i in range(len(u)) if i not in chosen), key=lambda i: (-far[i], ids[i])))
        far = np.minimum(far, np.round(1 - u @ u[chosen[-1]], 12))
    return sorted(ids[chosen].tolist()), far.max()


def radius(x, ids, chosen):
    u = blocks.unit_rows(x)
    return (1 - u @ u[np.isin(ids, list(chosen))].T).min(1).max()


def made(n, seed, d=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) + 3 * rng.normal(size=(6, d))[rng.integers(0, 6, n)]
    x[n // 2 : n // 2 + n // 9] = x[: n // 9]
    return x, rng.permutation(10 * n)[:n]


def test_one_batch_is_the_plain_choice(spark):
    x, ids = made(120, 6)
    want, _ = plain(x, ids, 12)
    bank = bank_of(spark, x, ids)
    for parts in (1, 7):
        assert sorted(r.bank_id for r in coresets.coreset(bank.repartition(parts), 12).collect()) == want
    got = coresets.core_set(bank, 12).collect()
    assert sorted(r.bank_id for r in got) == want and sum(r.rows for r in got) == 120 and max(r.far for r in got) == 2


@pytest.mark.parametrize("n", [6, 150])
def test_trees_and_cells_cover_within_the_bound(spark, n):
    """6 of 900 rows by a tree of batches of 60; 150 by trees in cells."""
    x, ids = made(900, 8)
    bank, bytes_of_60 = bank_of(spark, x, ids), 60 * 5 * 8
    sets = [sorted(r.bank_id for r in coresets.coreset(bank.repartition(p), n, batch_bytes=bytes_of_60).collect()) for p in (1, 5)]
    assert sets[0] == sets[1] and len(sets[0]) == n and ids.min() in sets[0]
    _, best = plain(x, ids, n)
    angle = lambda r: float(np.arccos(1 - r))
    found = angle(radius(x, ids, sets[0]))
    assert found <= (2 if n == 6 else 3) * angle(best)
    rows = coresets.core_set(bank, n, batch_bytes=bytes_of_60).collect()
    assert found <= max(r.angle for r in rows) + 1e-9
    if n == 6:  # the carried counts and angles are those of a cover
        assert sum(r.rows for r in rows) == 900


def test_pass_count_does_not_depend_on_n(spark, monkeypatch):
    x, ids = made(400, 3)
    bank, written = bank_of(spark, x, ids), []
    monkeypatch.setattr(coresets, "staged", lambda df, name: written.append(name) or df.cache())
    counts = []
    for n in (2, 8, 20):
        written.clear()
        assert coresets.core_set(bank, n, batch_bytes=50 * 5 * 8).count() == n
        counts.append(len(written))
    assert max(counts) <= 8


def test_edges(spark):
    x, ids = made(30, 2)
    bank = bank_of(spark, x, ids)
    assert coresets.coreset(bank.limit(3), 9).count() == 3 and coresets.coreset(bank.limit(0), 9).count() == 0 and coresets.coreset(bank, 0).count() == 0
    assert coresets.core_set(bank, 99, batch_bytes=8).count() == 30
    holes = bank.unionByName(spark.createDataFrame([(None, [1.0] * 5), (5, None)], bank.schema)).withColumn("far", F.lit("x"))
    assert coresets.coreset(holes, 4).columns == ["bank_id", "embedding", "far"] and coresets.core_set(holes, 4).count() == 4
    same = bank_of(spark, np.ones((50, 5)), np.arange(50))
    assert sorted(r.bank_id for r in coresets.coreset(same, 3).collect()) == [0, 1, 2] and coresets.core_set(same, 20, batch_bytes=10 * 5 * 8).count() == 20


def test_cover_radius(spark, sf):
    bank = patches(spark, sf).withColumnRenamed("vec_id", "bank_id")
    small, large = (coresets.cover_radius(bank, coresets.coreset(bank, n)).head() for n in (5, 40))
    assert (small.size, large.size) == (5, 40) and 0 < large.radius < small.radius
