import itertools
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import functions as F

from gridsift.llm import language
from gridsift.llm.q_language import op10_language_crf
from gridsift.llm.words import word_hashes


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(3)
    at = np.array([0, 4, 4, 5, 8])
    e, move = rng.normal(size=(8, 3)), rng.normal(size=(3, 3))
    chain = language.Chain(at)
    p, moved = chain.marginals(e[chain.word], move, True)
    got = np.empty_like(p)
    got[chain.word] = p
    want, pairs = np.zeros_like(e), np.zeros_like(move)
    for a, b in itertools.pairwise(at):
        paths = list(itertools.product(range(3), repeat=b - a))
        w = np.array([np.exp(sum(e[a + i, y] for i, y in enumerate(q)) + sum(move[x, y] for x, y in itertools.pairwise(q))) for q in paths])
        w /= w.sum()
        for q, v in zip(paths, w):
            for i, y in enumerate(q):
                want[a + i, y] += v
            for x, y in itertools.pairwise(q):
                pairs[x, y] += v
    assert np.allclose(got, want) and np.allclose(moved, pairs)


def test_features_are_ngrams_with_marks():
    from gridsift.llm.words import LOWER, placed

    (_, _, h, _, s, e, _), = placed(pa.array(["ab abc ab"]))
    raw = LOWER[np.frombuffer(b"ab abc ab", np.uint8)]
    slots, off = language.word_features(raw, s, e, h)
    words = [sorted(slots[off[i] : off[i + 1]].tolist()) for i in range(3)]
    assert words[0] == words[2] and len(words[0]) == 4 + 3 + 2 + 1 and len(words[1]) == 5 + 4 + 3 + 2
    assert len(set(words[0]) & set(words[1])) >= 5


def test_held_out_accuracy_and_rules(spark):
    sf = "/root/testdata/sf0.01"
    out = op10_language_crf(spark, sf).toPandas().set_index("doc_id")
    lang = dict(duckdb.sql(f"select doc_id, lang from '{sf}/documents.parquet'").fetchall())
    held = out[out.held_out]
    assert 0.25 < len(held) / len(out) < 0.42
    right = [lang[d] == p for d, p in held.lang_pred.items() if lang[d] is not None]
    assert np.mean(right) > 0.97
    assert out.score.between(0, 1).all()


def test_code_switched_text(spark):
    texts = ["the cat and the dog " * 20, "le chat et le chien " * 20, "der hund und die katze " * 20]
    docs = spark.createDataFrame([(i, t * 2, x) for i, (t, x) in enumerate(zip(texts * 3, ["en", "fr", "de"] * 3))], "doc_id long, text string, lang string")
    model = language.trained(docs)
    assert model.languages == ["de", "en", "fr"]
    rows = [(1, texts[0] + texts[1]), (2, None), (3, ""), (4, "123 456 !!"), (5, texts[2]), (5, texts[2]), (6, "the cat " * 60000)]
    df = spark.createDataFrame([(*r, "zz", 1.0) for r in rows], "doc_id long, text string, lang_pred string, score double")
    got = language.identify(df, model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and by[1].n_switches == 1 and 0.4 < by[1].score < 0.7
    assert [by[i].lang_pred for i in (2, 3, 4, 5, 6)] == ["und"] * 3 + ["de", "en"] and by[2].score == 0
    assert language.identify(df.limit(0), model).count() == 0
    nothing = language.trained(docs.limit(0))
    assert {r.lang_pred for r in language.identify(df, nothing).collect()} == {"und"}


def test_spans_of_a_mixed_text(spark):
    texts = ["the cat and the dog " * 20, "le chat é et le chien " * 20]
    docs = spark.createDataFrame([(i, t * 2, x) for i, (t, x) in enumerate(zip(texts * 3, ["en", "fr"] * 3))], "doc_id long, text string, lang string")
    model = language.trained(docs)
    mixed = "12 " + texts[1] + "!! " + texts[0] + "99"
    rows = [(0, None), (1, mixed), (2, "123 !!"), (3, texts[0]), (4, ""), (5, mixed)]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), model).collect()}
    assert [len(got[i].spans) for i in range(6)] == [0, 2, 0, 1, 0, 2]
    for i in (1, 5):
        part = [mixed.encode()[x.start : x.end].decode() for x in got[i].spans]
        assert part == [texts[1].strip(), texts[0].strip()] and [x.lang for x in got[i].spans] == ["fr", "en"] and got[i].n_switches == 1
        assert all(0.5 < x.marginal <= 1 for x in got[i].spans)
    assert language.identify(docs, language.trained(docs.limit(0))).where("size(spans) > 0").count() == 0


def test_rows_of_the_query_against_plain_forward_backward(spark, sf):
    docs = duckdb.sql(f"select doc_id, text, lang from '{sf}/documents.parquet'").fetchall()
    held = {d: zlib.crc32(str(d).encode()) % 3 == 1 for d, *_ in docs}
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = language.trained(table.where(~F.col("doc_id").isin([d for d, h in held.items() if h])))
    move = model.move.astype(np.float32).astype(float)

    def plain(text):
        if not text or not regex.search(r"\p{L}", text):
            return "und", 0.0
        low = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
        words = re.findall(rb"[^\x20\x09-\x0D]+", low)
        e = []
        for w in words:
            raw = np.frombuffer(w, np.uint8)
            slots, _ = language.word_features(raw, np.array([0]), np.array([len(raw)]), word_hashes(raw, np.array([0]), np.array([len(raw)])))
            e.append(model.weights[slots].astype(float).sum(0))
        f, back = [e[0]], [np.zeros(len(model.languages))]
        for x in e[1:]:
            f.append(np.logaddexp.reduce(f[-1][:, None] + move, axis=0) + x)
        for x in e[:0:-1]:
            back.append(np.logaddexp.reduce(move + (x + back[-1])[None, :], axis=1))
        p = np.array(f) + np.array(back[::-1])
        p = np.exp(p - p.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        lettered = [k for k, w in enumerate(words) if any(97 <= b <= 122 or b >= 128 for b in w)]
        mean = p[lettered].mean(0) if lettered else np.full(len(model.languages), 1 / len(model.languages))
        return model.languages[int(mean.argmax())], mean.max()

    got = {r.doc_id: r for r in op10_language_crf(spark, sf).collect()}
    assert len(got) == len(docs) and len({r.lang_pred for r in got.values()}) > 2
    for d, text, _ in docs:
        name, score = plain(text)
        assert (got[d].held_out, got[d].lang_pred) == (held[d], name) and abs(got[d].score - score) < 1e-3


def test_sample_is_bounded_where_rows_repeat(spark):
    rows = spark.range(5000).selectExpr("CASE WHEN id < 3000 THEN 7 ELSE id END AS doc_id", "CASE WHEN id < 3000 THEN 'same words' ELSE concat('word ', id) END AS text", "'en' AS lang")
    texts, langs = language.sample(rows, "text", "lang", "doc_id", 30)
    assert len(texts) == len(set(texts)) == 30 and set(langs) == {"en"}
