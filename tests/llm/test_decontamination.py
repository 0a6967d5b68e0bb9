import itertools
import random
import re
import string
import time
import tracemalloc

import numpy as np
import pyarrow as pa

from gridsift.llm import decontamination as dc


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower().translate(str.maketrans(string.punctuation, " " * len(string.punctuation))))


def smith_waterman(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        row, best = new, max(best, *new)
    return best / (2 * len(a)) if a else 0


def corpus():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(400)] + ["the", "of", "and"] * 60
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, text(rng.randint(15, 50))) for i in range(12)] + [(50, "two words"), (51, "single"), (52, None), (53, ""), (54, "the of and")]
    docs = []
    for i in range(120):
        w = words(text(rng.randint(0, 200)))
        if i % 2:
            copy = words(rng.choice(items[:12])[1])
            for _ in range(rng.randint(0, len(copy) // 3)):
                k = rng.randrange(len(copy))
                copy[k : k + 1] = rng.choice([[], [rng.choice(vocabulary)], [copy[k], "extra"]])
            k = rng.randint(0, len(w))
            w[k:k] = [x.upper() + "," for x in copy]
        docs.append((i, " ".join(w)))
    return docs + [(900, None), (901, ""), (902, docs[1][1]), (902, docs[1][1])], items


def test_against_brute_force(spark):
    docs, items = corpus()
    got = dc.leaks(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int").repartition(5), spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")).collect()
    found = sorted((r.doc_id, r.item_id, round(r.score, 6)) for r in got)
    brute = sorted((d, i, round(s, 6)) for d, t in docs for i, q in items if (s := smith_waterman(words(q), words(t))) >= dc.THRESHOLD)
    long_items = {i for i, q in items if len(words(q)) > 5}
    same = lambda rows: [x for x in rows if x[1] in long_items]
    assert len(same(brute)) > 50
    missed = set(same(brute)) - set(found)
    assert not set(same(found)) - set(same(brute))
    # an edited copy may have no three words left in a row: that is what a seed needs
    assert all(s < 0.75 for *_, s in missed) and len(missed) <= 0.05 * len(same(brute))
    text = {d: t for d, t in docs}
    for r in got:
        if r.score == 1 and r.item_id in long_items:
            assert words(text[r.doc_id].encode()[r.start_byte : r.end_byte].decode()) == words(dict(items)[r.item_id])


def test_clean_rows_and_empty_tables(spark):
    docs, items = corpus()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([i for i in items if i[0] < 50], "item_id long, text string")
    bad = {r.doc_id for r in dc.leaks(d, b).collect()}
    assert sorted(r.doc_id for r in dc.decontaminated(d, b).collect()) == sorted(x for x, _ in docs if x not in bad)
    assert dc.leaks(d.limit(0), b).count() == 0 and dc.leaks(d, b.limit(0)).count() == 0 and dc.decontaminated(d, b.limit(0)).count() == len(docs)


def test_blocks_give_the_same(spark, monkeypatch):
    docs, items = corpus()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = lambda: sorted(dc.leaks(d, b).collect())
    whole, left = rows(), sorted(dc.decontaminated(d, b).collect(), key=repr)
    monkeypatch.setattr(dc, "BLOCK_WORDS", 60)
    assert rows() == whole and sorted(dc.decontaminated(d, b).collect(), key=repr) == left


def test_long_text_and_hot_passage():
    item = np.arange(1, 40, dtype=np.uint64)
    score, start, end = dc.align(item, [np.concatenate((np.full(9, 77, np.uint64), item)), item[5:30]])
    assert score.tolist() == [78, 50] and start.tolist() == [9, 0] and end.tolist() == [48, 25]
    text = " ".join(f"w{i}" for i in range(40))
    items = dc.Items([7], [text])
    found = dc.aligned(items, pa.array([("zz " * 300_000) + text, text * 0]))
    assert [(f[0], f[1], f[2]) for f in found] == [(0, 0, 1.0)]


def test_partial_copies_in_many_documents(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices(string.ascii_lowercase, k=6))
    for times, kind in itertools.product((5, 50, 500), ("fifth", "part")):
        item = [word() for _ in range(40)]
        copy = item[4:22] if kind == "part" else [word() if k % 5 == 4 else x for k, x in enumerate(item)]
        docs = [(k, " ".join([word() for _ in range(20)] + (copy if k % 2 else []) + [word() for _ in range(20)])) for k in range(2 * times)]
        d = spark.createDataFrame(docs, "doc_id long, text string")
        b = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
        got = {r.doc_id: r.score for r in dc.leaks(d, b).collect()}
        assert got == {k: smith_waterman(item, words(t)) for k, t in docs if k % 2}, (times, kind)
        assert sorted(r.doc_id for r in dc.decontaminated(d, b).collect()) == [k for k, _ in docs if k % 2 == 0]


def test_many_hits_and_wide_windows_give_the_same(monkeypatch):
    docs, items = corpus()
    texts = pa.array([t for _, t in docs] + [" ".join(t or "" for _, t in docs)])
    block = dc.Items([i for i, _ in items], [t for _, t in items])
    whole = sorted(dc.aligned(block, texts))
    assert whole
    for name, value in (("HITS", 1), ("CELLS", 50), ("WINDOWS", 3), ("PIECE", 10)):
        monkeypatch.setattr(dc, name, value)
        assert sorted(dc.aligned(block, texts)) == whole
    monkeypatch.setattr(dc, "_enough", lambda item, h, lo, hi, threshold: np.ones(len(lo), bool))
    assert sorted(dc.aligned(block, texts)) == whole


def test_long_repetitive_text_takes_bounded_time_and_memory():
    rng = random.Random(1)
    item = [f"w{i}" for i in range(60)]
    words_ = item[:3] * 58_000 + item
    for k in range(255):
        words_ += [f"z{rng.random()}" for _ in range(30)] + item[10 + k % 40 : 13 + k % 40]
    text, items = " ".join(words_), dc.Items([1], [" ".join(item)])
    assert len(text) > 678_000
    tracemalloc.start()
    began = time.process_time()
    found = dc.aligned(items, pa.array([text]))
    took, peak = time.process_time() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [x[:3] for x in found] == [(0, 0, 1.0)] and took < 5 and peak < 300e6
