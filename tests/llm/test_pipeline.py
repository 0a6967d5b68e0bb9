import hashlib

import duckdb
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from gridsift.llm import classifier, decontamination
from gridsift.llm.q_quality_rules import verdict_sql
from gridsift.llm.session import table

from .test_decontamination import smith_waterman, words
from .test_jaccard import brute


def test_against_plain_python_and_sql(spark, sf):
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    scored = classifier.quality_scores(table(spark, sf, "documents"), table(spark, sf, "labels")).where("kept").toPandas()
    c = duckdb.connect()
    c.register("good", scored[["doc_id"]])
    c.sql(f"create table kept as select d.* from '{sf}/documents.parquet' d semi join good using (doc_id)")
    rows = c.sql(f"select doc_id, text from kept semi join (select doc_id from ({verdict_sql('kept')}) where kept) using (doc_id)").fetchall()
    assert 0 < len(rows) < len(scored) < c.sql(f"select count(*) from '{sf}/documents.parquet'").fetchall()[0][0]
    first = {d for d, _, comp in brute(rows) if d == comp}
    items = [words(t) for (t,) in c.sql(f"select text from '{sf}/benchmark.parquet'").fetchall()]
    left = [(d, t) for d, t in rows if d in first]
    clean = {d: t for d, t in left if not any(smith_waterman(i, words(t)) >= decontamination.THRESHOLD for i in items if set(i) & set(words(t)))}
    assert 0 < len(clean) <= len(left) < len(rows)
    assert set(got) == set(clean)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for d, t in clean.items():
        ids = np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        assert bytes(got[d].ids) == ids and got[d].ids_sha256 == hashlib.sha256(ids).hexdigest() and got[d].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_rows_are_told_apart(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(40))
    other = " ".join(f"v{i * 7}" for i in range(40))
    rows = [(1, text), (1, text), (1, other), (None, text), (None, None), (2, text + " more"), (3, "few words"), (4, "x! " * 50)]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for stage in (corpus_pipeline.quality_classifier, corpus_pipeline.quality_filter, corpus_pipeline.near_duplicates, corpus_pipeline.decontaminate):
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    kept = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.doc_id == 1) == sorted([(1, text), (1, other)])
    assert not [r for r in kept if r.doc_id == 2 or (r.doc_id is None and r.text)]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.n_tokens for r in got) and {r.doc_id for r in got} == {1}
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_one_row_of_each_class_whatever_the_ids(spark, tmp_path):
    text = [" ".join(f"{x}{i}" for i in range(40)) for x in "abcdefg"]
    a, b, c, d, e, f, g = text
    unique = [(None, b), (None, c), (5, d), (None, None), (None, ""), (7, "")]
    classes = [
        [(1, a), (None, a), (None, a + " more"), (5, a + " more")],
        [(8, e), (8, e + " more"), (8, e + " even"), (8, e)],
        [(None, f), (None, f + " more"), (None, f), (None, f + " even")],
        [(9, g), (9, g + " more"), (3, g + " even"), (None, g)],
    ]
    docs = spark.createDataFrame([*unique, (7, ""), *(r for x in classes for r in x)], "doc_id long, text string")
    for _ in range(2):
        kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs.repartition(3), str(tmp_path)).collect()]
        firsts = [[r for r in kept if r in x] for x in classes]
        assert [len(x) for x in firsts] == [1] * 4 and firsts[0] == [(1, a)] and firsts[3] == [(3, g + " even")]
        assert sorted(kept, key=repr) == sorted([*unique, *(r for x in firsts for r in x)], key=repr)
