import random
import re

import duckdb
import numpy as np

from gridsift.llm import jaccard


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(docs):
    sets, up = [shingle_set(t) for _, t in docs], list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in where[x] if j > i}:
            both = len(s & sets[j])
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                up[root(j)] = root(i)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets))), key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(df).collect()), key=repr)


def edited():
    rng = random.Random(3)
    word = lambda: rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else "".join(rng.choices("abcdefg", k=4))
    common = " ".join(word() for _ in range(40))
    docs = [(None, "null id words here and there"), (1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one TWO"), (6, "two one"), (7, "a b c d e"), (8, "a b c d e f")]
    for f in range(12):
        base = [word() for _ in range(rng.randint(20, 300))]
        for _ in range(rng.randint(1, 25)):
            w = base[:]
            for _ in range(rng.randint(0, max(1, len(w) // 30))):
                w[rng.randrange(len(w))] = word()
            docs.append((len(docs) + 100, " ".join(w) + (" " + common if rng.random() < 0.4 else "")))
    docs += [(5000 + i, docs[20][1]) for i in range(30)] + [(7, "a b c d e")]
    rng.shuffle(docs)
    return docs


def test_against_brute_force(spark, monkeypatch):
    docs = edited()
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, set_id string").repartition(3)
    want = brute(docs)
    assert got(df) == want
    monkeypatch.setattr(jaccard, "GROUP", 6)
    monkeypatch.setattr(jaccard, "FREQUENT", 3)
    monkeypatch.setattr(jaccard, "BROADCAST_DOCS", 0)
    assert got(df) == want


def test_given_documents(spark, sf):
    docs = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    assert got(spark.read.parquet(f"{sf}/documents.parquet")) == brute(docs)


def test_empty_table(spark):
    assert got(spark.createDataFrame([], "doc_id long, text string")) == []


def test_traversal_keeps_every_link():
    rng = np.random.default_rng(4)
    base = [rng.integers(0, 1 << 63, rng.integers(5, 400), dtype=np.uint64) for _ in range(30)]
    sets = [np.unique(np.where(rng.random(len(b)) < 0.05, rng.integers(0, 1 << 63, len(b), dtype=np.uint64), b)) for b in base for _ in range(6)]
    tree = jaccard.SignatureTree(np.array([len(s) for s in sets]), jaccard._signatures(sets))
    pairs = {frozenset(p) for p in zip(*(x.tolist() for x in jaccard.traverse(tree, tree)))}
    links = {frozenset((i, j)) for i in range(len(sets)) for j in range(i) if 9 * len(np.intersect1d(sets[i], sets[j])) >= 4 * (len(sets[i]) + len(sets[j]))}
    assert len(links) > 50 and links <= pairs and len(pairs) < len(sets) ** 2 / 8
    s, t = (jaccard.SignatureTree(np.array([len(x) for x in part]), jaccard._signatures(part)) for part in (sets[:77], sets[77:]))
    cross = {frozenset((i, j + 77)) for i, j in zip(*(x.tolist() for x in jaccard.traverse(s, t)))}
    assert {p for p in links if min(p) < 77 <= max(p)} <= cross
