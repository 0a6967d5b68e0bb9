import heapq
import zlib

import duckdb
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridsift.llm import token_files as tf
from gridsift.llm.q_token_files import op4_token_files
from gridsift.llm.session import stage_path

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(1)
    n = rng.integers(1, 1000, 300)
    heap, cost = [*map(int, n)], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        cost += x
        heapq.heappush(heap, x)
    bits = tf.code_lengths(n, 30)
    assert (bits * n).sum() == cost and (0.5**bits).sum() == 1
    steep = 2 ** np.arange(40)
    assert tf.code_lengths(steep, 9).max() <= 9 and abs((0.5 ** tf.code_lengths(steep, 9)).sum() - 1) < 1e-9
    assert tf.code_lengths(np.array([5])).tolist() == [1] and len(tf.code_lengths(np.array([]))) == 0


def test_pack_and_unpack():
    rng = np.random.default_rng(2)
    ids = np.minimum(rng.zipf(1.3, 20000), 50000).astype(np.uint32)
    sizes = np.array([0, 1, tf.LANE, tf.LANE + 1, 0, 5000])
    sizes = np.append(sizes, len(ids) - sizes.sum())
    u, n = np.unique(ids, return_counts=True)
    codes = tf.Codes(u, tf.code_lengths(n))
    payload, doc_bytes, lanes = tf.pack(ids, sizes, *codes.encoder())
    assert (tf.unpack(payload, doc_bytes, sizes, lanes, codes.decoder(), codes.top) == ids).all()


def test_round_trip_against_the_library(spark, sf, monkeypatch):
    monkeypatch.setattr(tf, "PART_IDS", 20000)
    monkeypatch.setattr(tf, "BLOCK_IDS", 3000)
    library = Tokenizer.from_file(PATH)
    got = {r.doc_id: r for r in op4_token_files(spark, sf).collect()}
    start, rows = 0, duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet' order by doc_id").fetchall()
    assert len(got) == len(rows)
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_nulls_repeats_special_strings_and_empty_tables(spark):
    library = Tokenizer.from_file(PATH)
    rows = [(None, "a"), (1, None), (1, ""), (2, "a  <|endoftext|> b"), (2, "a  <|endoftext|> b"), (3, "x" * 50000)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, ids int")
    got = tf.round_trip(df, PATH, 2).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 1, 2, 2, 3]
    for r, (_, t) in zip(got, rows):
        assert list(memoryview(bytes(r.ids)).cast("I")) == library.encode(t or "", add_special_tokens=False).ids + [2]
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    assert tf.round_trip(df.limit(0), PATH, 2).count() == 0


def test_a_doc_id_with_most_rows_is_split(spark, monkeypatch):
    monkeypatch.setattr(tf, "PART_IDS", 200)
    monkeypatch.setattr(tf, "BLOCK_IDS", 50)
    rows = [(None if i % 3 else 7, f"word{i % 40} and more") for i in range(400)] + [(i, "few words here") for i in range(30)]
    path = stage_path(spark, "hot")
    got = tf.round_trip(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), PATH, 2, path).orderBy("start").collect()
    library = Tokenizer.from_file(PATH)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    want = sorted(((d, zlib.crc32(np.array(library.encode(t, add_special_tokens=False).ids + [2], "<u4").tobytes())) for d, t in rows), key=key)
    assert [(r.doc_id, zlib.crc32(r.ids)) for r in got] == want
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    parts = [r.n for r in spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n")).collect()]
    assert len(parts) > 8 and max(parts) < 4 * sum(parts) / len(parts)
