import os
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridsift.llm import q_spelling, spelling


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def edits(a, b):
    """Levenshtein distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def brute(docs, shortest=6, least=5, times=5, damage=199):
    n = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = lower(run)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if damage and h % damage == 0 else w] += 1
    n = {w: k for w, k in n.items() if len(w) >= shortest and k >= least}
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and v != w and edits(v, w) == 1] for w in n}
    best = {w: min(near[w], key=lambda v: (-n[v], v)) for w in n if near[w]}
    form = {w: v for w, v in best.items() if n[v] >= times * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out, key=repr)


def got(df, **options):
    rows = spelling.spelling_variants(df, **options)
    assert rows.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, rows.collect()), key=repr)


def frame(spark, docs):
    return spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, word string, n int").repartition(3)


def made(seed, letters, n_words):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 12))) for _ in range(n_words)]
    docs = [(i if i % 9 else None, " ".join(rng.choice(base[: rng.choice([9, n_words])]) for _ in range(200)) + rng.choice(["", "3x", "Œ"])) for i in range(60)]
    return docs + [(70, None), (71, ""), (72, "12 ... 字字字"), (73, ("Q" + "q" * 29_999 + " ") * 5), (73, ("q" * 29_999 + ".") * 30)]


@pytest.mark.parametrize("seed,letters,n_words", [(1, "ab", 300), (2, "abcé×À", 400), (3, "aAbB", 300)])
def test_against_brute_force(spark, monkeypatch, seed, letters, n_words):
    monkeypatch.setattr(spelling, "PIECE", 50)
    docs = made(seed, letters, n_words)
    short = [d for d in docs if d[0] != 73]
    assert got(frame(spark, short), damage=7) == brute(short, damage=7)
    assert any(r[0] == "q" * 29_999 and r[4] == 1 and r[1] is None for r in got(frame(spark, docs)))


def test_chains_of_forms(spark):
    chain = [("abcdefgh", 6), ("abcdefghi", 40), ("abcdefghij", 300), ("abcdefghijk", 2000)]
    docs = [(1, " ".join((w + " ") * k for w, k in chain))]
    assert got(frame(spark, docs)) == brute(docs, damage=None)
    assert {r[2] for r in got(frame(spark, docs))} == {"abcdefghijk"}


def test_long_lists_are_split(spark, monkeypatch):
    monkeypatch.setattr(spelling, "LIST", 5)
    docs = made(4, "ab", 300)[:60]
    assert got(frame(spark, docs)) == brute(docs, damage=None)
    docs = [(1, " ".join(f"prefixprefix{a}{b}{c} " * 5 for a in "abcdé" for b in "xyz" for c in ("", "k", "l", "mm")))]
    assert got(frame(spark, docs)) == brute(docs, damage=None)


def test_empty_tables(spark):
    assert got(frame(spark, [(1, "a")]).limit(0)) == [] and got(frame(spark, [(1, None), (2, "short words only")])) == []


words = st.text("abcé", min_size=6, max_size=12)


@settings(max_examples=300, deadline=None)
@given(words, st.integers(0, 11), st.text("abcé", max_size=1), st.booleans(), st.sets(st.text("abcé", min_size=2, max_size=4)))
def test_signatures_meet(word, at, letter, insert, frequent):
    """A word and its edit share a gram of both signatures, with equal sides, whatever is frequent."""
    other = word[:at] + letter + word[at + (not insert) :]
    assert spelling.one_edit(word, other) == (edits(word, other) == 1)
    if edits(word, other) != 1 or min(len(word), len(other)) < 2:
        return
    frequent = {g: len(g) for g in frequent if all(g[:k] in frequent for k in range(2, len(g)))}
    lists = [{(e - p, side, (w + "\n")[:e] if side else (w + "\n")[p:]) for p, e in spelling.signature(w, frequent) for side in (True, False)} for w in (word, other)]
    assert lists[0] & lists[1]


@given(st.text("ab", max_size=90), st.text("ab", max_size=90))
def test_deletion_hashes(a, b):
    strings = [{a, *(a[:i] + a[i + 1 :] for i in range(len(a)))}, {b, *(b[:i] + b[i + 1 :] for i in range(len(b)))}]
    hashes = [set(spelling._deletion_hashes(x).tolist()) for x in (a, b)]
    assert len(hashes[0]) == len(strings[0]) and len(hashes[0] & hashes[1]) == len(strings[0] & strings[1])


def test_same_rows_as_duckdb(spark, sf):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{os.path.join(sf, 'documents.parquet')}'")
    df = q_spelling.op13_spelling_variants(spark, sf)
    found = c.sql(q_spelling.SQL)
    at = [found.columns.index(x) for x in df.columns]
    rows = sorted(map(tuple, df.collect()), key=repr)
    assert rows == sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=repr)
    assert any(r[1] for r in rows)
