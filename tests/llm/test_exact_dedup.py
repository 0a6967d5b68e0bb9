import hashlib
import os
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridsift.llm import exact_dedup, q_exact_dedup, quotient


@settings(max_examples=60, deadline=None)
@given(st.sampled_from([3, 8, 17, 44, 64]), st.lists(st.lists(st.integers(0, 2**64 - 1), max_size=40), max_size=5))
def test_filters_merge_without_loss(bits, lists):
    whole, filters = {}, []
    for xs in lists:
        x, n = np.unique(np.array([v % 2**bits for v in xs], np.uint64), return_counts=True)
        filters.append(quotient.build(x, n, bits))
        back = quotient.items(filters[-1])
        assert (back[0] == x).all() and (back[1] == n).all()
        for v, k in zip(x.tolist(), n.tolist(), strict=True):
            whole[v] = whole.get(v, 0) + k
    x, n = quotient.items(quotient.merge(filters, bits))
    assert list(zip(x.tolist(), n.tolist(), strict=True)) == sorted(whole.items())


def test_same_rows_as_duckdb(spark, sf):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{os.path.join(sf, 'documents.parquet')}'")
    df = q_exact_dedup.op12_exact_dedup(spark, sf)
    found = c.sql(q_exact_dedup.SQL)
    at = [found.columns.index(x) for x in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in at) for r in found.fetchall())


def rows_of(seed=1):
    rng = random.Random(seed)
    texts = [None, "", "A", "a", "a ", "é", "é", "x" * 300_000, "y " * 200_000, *(f"t{i}" for i in range(20))]
    rows = [(rng.choice([None, rng.randrange(500)]) if i % 17 == 0 else i, rng.choice(texts)) for i in range(300)]
    return rows + [(1000 + i, "hot") for i in range(200)] + [(1, "twice")] * 3 + [(None, "nobody")] * 2


@pytest.mark.parametrize("bits,broadcast,segment", [(64, 500_000, 1 << 20), (3, 500_000, 1 << 20), (64, 0, 8), (5, 0, 64)])
def test_against_brute_force(spark, monkeypatch, bits, broadcast, segment):
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(exact_dedup, "SEGMENT", segment)
    monkeypatch.setattr(exact_dedup, "HOT", 4)
    rows = rows_of()
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    df = spark.createDataFrame([(*r, "other", 7, 8) for r in rows], "doc_id long, text string, keep_id string, seq int, fp int").repartition(6)
    got = exact_dedup.exact_dedup(df, bits).collect()
    want = []
    for t, ids in groups.items():
        keep = max((d for d in ids if d is not None), default=None)
        want += [(d, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for d in ids]
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == sorted(want, key=repr)
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) == len({r.text_sha256 for r in kept}) and all(r.doc_id == r.keep_id for r in kept)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got if r.doc_id not in (1, None) and [d for d, _ in rows].count(r.doc_id) == 1)


def test_empty_table(spark):
    df = exact_dedup.exact_dedup(spark.createDataFrame([], "doc_id long, text string"))
    assert df.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and df.count() == 0


def test_repeated_fingerprints(spark):
    df = spark.createDataFrame([(x,) for x in [5, 5, -1, -1, -1, 0, None, None, 2**63 - 1, -(2**63)]], "fp long")
    assert sorted(map(tuple, exact_dedup.repeated_fingerprints(df).collect())) == [(-1, 3), (5, 2)]
