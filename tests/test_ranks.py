"""Ranks, ranges and predecessors against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from gridsift.operators import metrics, prototypes, ranks
from gridsift.plans.projection import patches


def rows_of():
    rng = random.Random(3)
    return [(rng.choice([None, "a", "b"]) if i > 3 else "lone" + str(i), rng.randrange(50), i) for i in range(300)] + [("hot", 7, 1000 + i) for i in range(200)]


@pytest.mark.parametrize("parts", [1, 5])
def test_numbers_ranges_and_predecessors(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        rows = rows_of()
        df = spark.createDataFrame(rows, "g string, v int, id int").repartition(3)
        want = sorted(rows, key=lambda r: (-r[1], r[2]))
        got = {r.id: r.n for r in ranks.numbered(df, [F.desc("v"), F.asc("id")], "n").collect()}
        assert got == {r[2]: i + 1 for i, r in enumerate(want)}
        groups, last, before = {}, {}, {}
        for g, v, i in sorted(rows, key=lambda r: (r[1], r[2])):
            groups.setdefault(g, []).append(v)
            before[i], last[g] = last.get(g), (v, i)
        assert {r.id: (r._lo, r._hi) for r in ranks.with_range(df, ["g"], "v").collect()} == {i: (min(groups[g]), max(groups[g])) for g, v, i in rows}
        assert {(r._lo, r._hi) for r in ranks.with_range(df, [], "v").collect()} == {(min(r[1] for r in rows), max(r[1] for r in rows))}
        got = {r.id: None if r._prev_id is None else (r._prev_v, r._prev_id) for r in ranks.with_previous(df, ["g"], [F.asc("v"), F.asc("id")], ["v", "id"]).collect()}
        assert got == before
        assert ranks.with_previous(df, [], [F.asc("id")], ["id"]).where("_prev_id IS NULL").count() == 1
        assert ranks.numbered(df.limit(0), [F.asc("id")], "n").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_areas_have_no_window_over_a_group(spark):
    df = spark.createDataFrame([("a", float(s), s % 3 == 0) for s in range(60)], "g string, score double, target boolean")
    curve = metrics.roc_curve(df.withColumn("target", F.col("target").cast("int")), ["g"])
    plan = metrics.auc(curve, ["g"], "fpr", "tpr")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line]
    assert windows and all("_task" in line for line in windows)


def test_masked_prototypes_shuffle_no_vectors(spark, sf):
    p = patches(spark, sf).withColumn("m", F.col("label") == 1)
    plan = prototypes.masked_prototype(p, ["image_id"], "m")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Aggregate") == 2
    none = prototypes.masked_prototype(p.withColumn("m", F.lit(None).cast("boolean")), ["image_id"], "m").collect()
    every = prototypes.masked_prototype(p.withColumn("m", F.lit(True)), ["image_id"], "m").collect()
    assert sorted((r.image_id, [round(x, 9) for x in r.embedding]) for r in none) == sorted((r.image_id, [round(x, 9) for x in r.embedding]) for r in every)


def test_prototype_scores_by_blocks(spark, sf, monkeypatch):
    p = patches(spark, sf)
    q = p.unionByName(p.limit(1).withColumn("vec_id", F.lit(-1).cast("long")).withColumn("embedding", F.lit(None).cast("array<double>")))
    protos = p.where("image_id = '0'").select(F.col("label").alias("g"), "embedding")
    score = lambda how, group: {(r.vec_id, *(r[g] for g in group)): r.score if r.score is None else round(r.score, 9) for r in prototypes.score_prototypes(q, protos, ["vec_id"], how, group).collect()}
    for how in ("max", "mean"):
        for group in ([], ["g"]):
            monkeypatch.setattr(prototypes, "PROTOTYPE_BYTES", 64 << 20)
            whole = score(how, group)
            monkeypatch.setattr(prototypes, "PROTOTYPE_BYTES", 30 * 64 * 8)
            assert score(how, group) == whole and whole[next(k for k in whole if k[0] == -1)] is None
    with pytest.raises(ValueError):
        monkeypatch.setattr(prototypes, "EXEMPLAR_TOKENS", 3)
        prototypes._few(p)


@pytest.mark.parametrize("parts", [1, 6])
def test_quantiles(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        rng = random.Random(8)
        rows = [(rng.choice([None, "a", "b"]), None if rng.random() < 0.1 else float(rng.randrange(30)), i % 2) for i in range(200)] + [("hot", float(i % 7), 0) for i in range(300)] + [("nulls", None, 1), ("one", 4.0, 1)]
        df = spark.createDataFrame(rows, "g string, x double, side int").repartition(4)
        odd = F.when(F.col("side") == 1, F.col("x"))
        for keys in (["g"], []):
            got = {r.g if keys else 0: (r.m, r.q, r.o) for r in ranks.quantiles(df, keys, {"m": (F.col("x"), 0.5), "q": (F.col("x"), 0.9), "o": (odd, 0.25)}).collect()}
            want = {r.g if keys else 0: (r.m, r.q, r.o) for r in df.groupBy(*keys).agg(F.median("x").alias("m"), F.percentile("x", F.lit(0.9)).alias("q"), F.percentile(odd, F.lit(0.25)).alias("o")).collect()}
            assert got.keys() == want.keys()
            for k, v in want.items():
                assert all(a == b if b is None else a == pytest.approx(b) for a, b in zip(got[k], v, strict=True))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
