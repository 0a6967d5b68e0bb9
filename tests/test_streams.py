"""Keyed streams against their batch forms: pieces, restarts, late rows, timers."""

from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridsift.functions import blocks
from gridsift.operators import knn, labels, retrieval
from gridsift.plans.projection import patches
from gridsift.streaming import streams

LOG = "id int, k string, seq int, op string"


def scores_of(spark, path):
    rows = spark.read.schema("image_id string, image_score double, patches long, complete boolean").option("recursiveFileLookup", "true").parquet(str(path)).collect()
    assert len({r.image_id for r in rows}) == len(rows)
    return {r.image_id: (round(r.image_score, 9), r.patches, r.complete) for r in rows}


def test_images_in_pieces_score_as_in_a_batch(spark, sf, tmp_path):
    p = patches(spark, sf).drop("labels")
    bank = p.where("split = 'train'").withColumnRenamed("vec_id", "bank_id")
    q = p.where("split <> 'train'")
    write = lambda df: df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        src = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        streams.stream_anomaly_scores(src, bank, 3, str(tmp_path / "out"), str(tmp_path / "cp"), 100, 0.05).awaitTermination()

    write(q.where("row < 3"))
    write(q.where("row BETWEEN 3 AND 6"))
    run()
    assert scores_of(spark, tmp_path / "out") == {} if list((tmp_path / "out").glob("*/*.parquet")) else True
    write(q.where("row > 6 AND image_id = '3'"))  # a stream that goes on later
    write(q.where("row > 6 AND image_id = '4'").limit(20))
    run()
    s = knn.anomaly_scores(q.withColumnRenamed("vec_id", "query_id"), bank, 3).join(q.select(F.col("vec_id").alias("query_id"), "image_id"), "query_id")
    want = {r.image_id: round(r.image_score, 9) for r in retrieval.top_fraction_mean(s, ["image_id"], "score", 0.05).collect()}
    assert {k: v[0] for k, v in scores_of(spark, tmp_path / "out").items()} == {"3": want["3"]}
    write(q.where("row > 6 AND image_id = '4'").exceptAll(q.where("row > 6 AND image_id = '4'").limit(20)))
    run()
    got = scores_of(spark, tmp_path / "out")
    assert {k: v[0] for k, v in got.items()} == want and all(v[1:] == (100, True) for v in got.values())
    with pytest.raises(ValueError):
        streams.stream_anomaly_scores(q, bank.limit(2), 3, "", "", 100)


def wide(ids):
    return np.stack([np.random.default_rng(int(i)).normal(size=4096).astype(np.float32) for i in ids])


def test_a_bank_of_more_than_200_mb_is_met_in_parts(spark, tmp_path):
    def vectors(batches):
        for b in batches:
            for i in range(0, b.num_rows, 500):
                ids = b.column(0).slice(i, 500)
                yield pa.RecordBatch.from_arrays([ids, pa.array(list(wide(ids.to_numpy())), pa.list_(pa.float32()))], ["id", "embedding"])

    rows = lambda a, b: spark.range(a, b, 1, 4).mapInArrow(vectors, "id long, embedding array<float>")
    n = (200 << 20) // (8 * 4096) + 100
    q = rows(10**6, 10**6 + 30).selectExpr("CAST(id % 3 AS STRING) AS image_id", "embedding")
    q.coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(q.schema).parquet(str(tmp_path / "in"))
    streams.stream_anomaly_scores(src, rows(0, n).withColumnRenamed("id", "bank_id"), 3, str(tmp_path / "out"), str(tmp_path / "cp"), 10, 0.2).awaitTermination()
    x, y = (blocks.unit_rows(wide(i).astype(float)) for i in (np.arange(10**6, 10**6 + 30), np.arange(n)))
    far = np.sort(1 - x @ y.T, axis=1)[:, :3].mean(1)
    want = {str(i): round(float(np.sort(far[np.arange(10**6, 10**6 + 30) % 3 == i])[-2:].mean()), 9) for i in range(3)}
    assert scores_of(spark, tmp_path / "out") == {i: (pytest.approx(v, abs=2e-9), 10, True) for i, v in want.items()}


def test_parts_of_a_bank(spark):
    rng = np.random.default_rng(3)
    y = rng.normal(size=(2500, 8))
    y[7, 2] = np.nan  # near to none
    y[100:130] = y[5]
    x = blocks.unit_rows(np.concatenate((y[5:6], rng.normal(size=(300, 8)))))
    want = -np.sort(-np.delete(x @ blocks.unit_rows(y).T, 7, 1), axis=1)[:, :4]
    bank = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "bank_id long, embedding array<double>").repartition(3)
    for most in (None, 0):
        n, parts = knn.bank_parts(bank, bank_bytes=most)
        assert n == 2500 and len(list(parts())) == (1 if most is None else 3)
        assert np.allclose(blocks.greatest(x, parts(), 4), want, atol=1e-12)
    assert np.isinf(blocks.greatest(x, [blocks.unit_rows(y[:2])], 4)).sum(1).tolist() == [2] * 301


def test_incomplete_images_are_written_by_a_timer(spark, tmp_path):
    rng, start = np.random.default_rng(1), datetime(2024, 1, 1)
    schema = "image_id string, t timestamp, embedding array<double>"
    vectors = rng.normal(size=(9, 4))
    bank = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "bank_id long, embedding array<double>")

    def add(rows):
        spark.createDataFrame([(i, start + timedelta(minutes=m), v.tolist()) for i, m, v in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    x = rng.normal(size=(6, 4))
    add([("a", 0, x[0]), ("a", 1, x[1]), ("b", 0, x[2])])
    add([("b", 2, x[3]), ("c", 200, x[4])])
    add([("d", 900, x[5])])
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streams.stream_anomaly_scores(src, bank, 1, str(tmp_path / "out"), str(tmp_path / "cp"), 3, 0.5, time="t", wait_seconds=600, delay="1 minute").awaitTermination()
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    far = 1 - (unit(x) @ unit(vectors).T).max(1)
    got = scores_of(spark, tmp_path / "out")
    assert got == {"a": (round(max(far[0], far[1]), 9), 2, False), "b": (round(max(far[2], far[3]), 9), 2, False), "c": (round(far[4], 9), 1, False)}


def put(spark, folder, rows):
    spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(str(folder))


def fold(spark, tmp_path, **options):
    src = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streams.stream_annotations(src, ["k"], ["seq"], str(tmp_path / "out"), str(tmp_path / "cp"), **options).awaitTermination()
    return {(r.k, r.id, r.seq) for r in streams.read_annotations_state(spark, str(tmp_path / "cp")).collect()}


def test_folded_log_over_restarts(spark, tmp_path):
    pieces = [
        [(1, "a", 1, "upsert"), (3, "b", 2, "upsert"), (9, None, 1, "upsert")],
        [(2, "a", 3, "delete"), (5, "c", 1, "delete"), (8, "d", None, "upsert")],
        [(4, "a", 2, "upsert"), (6, "c", 4, "upsert"), (7, "b", 1, "delete"), (8, "d", 0, "delete")],
    ]
    done = []
    for piece in pieces:
        put(spark, tmp_path / "in", piece)
        done += piece
        got = fold(spark, tmp_path)
        want = {(r.k, r.id, r.seq) for r in labels.fold_log(spark.createDataFrame(done, LOG), ["k"], ["seq"]).collect()}
        assert got == want
    sizes = [spark.read.schema(LOG).parquet(str(f)).count() for f in sorted((tmp_path / "out").glob("batch=*"))]
    assert sizes == [3, 3, 2]  # changed keys only, nothing is written again
    assert not [k for k in streams._STORE if spark.conf.get(k, None) == streams._STORE[k]]


def test_tombstones_expire_and_states_begin(spark, tmp_path):
    schema = "id int, k string, seq int, op string, t timestamp"
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    add = lambda *rows: spark.createDataFrame([(*r[:4], at(r[4])) for r in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    first = spark.createDataFrame([(1, "a", 5, "upsert", at(0)), (2, "b", 5, "upsert", at(0)), (3, "x", 5, "delete", at(0))], schema)

    def run():
        src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        streams.stream_annotations(src, ["k"], ["seq"], str(tmp_path / "out"), str(tmp_path / "cp"), time="t", keep_seconds=600, delay="5 minutes", initial=first).awaitTermination()
        return {(r.k, r.id, r.seq) for r in streams.read_annotations_state(spark, str(tmp_path / "cp")).collect()}

    add((10, "a", 9, "delete", 1), (11, "b", 4, "upsert", 2), (12, "x", 4, "upsert", 3))
    assert run() == {("b", 2, 5)}
    add((13, "a", 7, "upsert", 4), (14, "b", 6, "upsert", 90))  # late for a's tombstone, and the watermark goes on
    assert run() == {("b", 14, 6)}
    add((15, "a", 8, "upsert", 91), (16, "c", 1, "upsert", 3))  # a's tombstone is gone, c comes too late
    assert run() == {("a", 15, 8), ("b", 14, 6)}


def test_a_fold_without_times_keeps_python_out_of_its_keys(spark, tmp_path):
    put(spark, tmp_path / "in", [(1, "a", 5, "upsert"), (2, "b", 5, "delete")])
    assert fold(spark, tmp_path) == {("a", 1, 5)}
    put(spark, tmp_path / "in", [(3, "a", 5, "upsert"), (4, "b", 5, "upsert"), (5, "b", 4, "upsert")])
    assert fold(spark, tmp_path) == {("a", 3, 5), ("b", 4, 5)}  # of equal ones the later to come
    assert {r.operatorName for r in spark.read.format("state-metadata").load(str(tmp_path / "cp")).collect()} == {"stateStoreSave"}
