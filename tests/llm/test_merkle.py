import hashlib
import os
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from gridsift.llm import merkle, q_merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def paths(leaves):
    """The root of a list of digests, and of each the (left, right) siblings on its levels."""
    found, at, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        for i, p in enumerate(found):
            run = nodes[at[i] // 16 * 16 :][:16]
            p.append(("".join(run[: at[i] % 16]), "".join(run[at[i] % 16 + 1 :])))
        nodes = [h(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
        at = [a // 16 for a in at]
    return nodes[0], found


def brute(rows):
    groups = {}
    for r in rows:
        d, text, lang, source, n = r
        head = [enc(d), enc(source), enc(lang), enc(n)]
        lower = text if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        bad = zlib.crc32(str(d).encode()) % 5 == 0 if d is not None else False
        groups.setdefault(source, []).append((d is not None, d or 0, h(*head, enc(text)), h(*head, enc(lower if bad else text)), d))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: (sorted(groups[s]), *paths([x[2] for x in sorted(groups[s])])) for s in order}
    root, above = paths([own[s][1] for s in order])
    out = []
    for s, up in zip(order, above, strict=True):
        for (_, _, leaf, claimed, d), path in zip(own[s][0], own[s][2], strict=True):
            f = claimed
            for a, b in path + up:
                f = h(a, f, b)
            out.append((d, leaf, own[s][1], root, h(*[x for p in path + up for x in p]), f, f == root))
    return sorted(out, key=repr)


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, g string, lo int").repartition(5)


def got(spark, df):
    text = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.translate("text", q_merkle.UPPER, q_merkle.LOWER))
    rows = merkle.document_manifest(df, text).select("doc_id", "leaf", "subroot", "root", merkle.proof_digest().alias("p"), merkle.folded(F.col("claimed")).alias("f"))
    return sorted(map(tuple, rows.withColumn("v", F.col("f") == F.col("root")).collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    source = [None, "", "a", "B", "é", "zz", *(f"s{i}" for i in range(40))] if seed == 1 else ["only"]
    rows = [(i, rng.choice([None, "", "Abc", "abc", "É A" * rng.randrange(9)]), rng.choice([None, "en"]), rng.choice(source), rng.choice([None, 3])) for i in range(200)]
    rows += [(1000 + i, "Hot", "en", "a" if seed == 1 else "only", 3) for i in range(700)]
    rows += [(7, "Same", "en", "a", 3)] * 40 + [(None, "Null", None, "a", None)] * 3 + [(5001, "L" * 300_000 + "\n", "en", "lone", 1)]
    assert got(spark, docs(spark, rows)) == brute(rows)


@pytest.mark.parametrize("n", [1, 2, 16, 17])
def test_few_leaves(spark, n):
    rows = [(i, "T", None, "s", 1) for i in range(n)]
    assert got(spark, docs(spark, rows)) == brute(rows)


def test_empty_table(spark):
    df = docs(spark, [(1, "a", "b", "c", 1)]).limit(0)
    assert merkle.document_manifest(df).columns == ["doc_id", "leaf", "claimed", "subroot", "root", "path"] and merkle.document_manifest(df).count() == 0


def test_untampered_leaves_are_their_claims(spark):
    rows = merkle.document_manifest(docs(spark, [(i, "Ab", "en", "s", 2) for i in range(30)])).withColumn("f", merkle.folded(F.col("claimed"))).collect()
    assert len(rows) == 30 and all(r.leaf == r.claimed and r.f == r.root for r in rows)


def test_same_rows_as_duckdb(spark, sf):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{os.path.join(sf, 'documents.parquet')}'")
    df = q_merkle.op11_merkle_manifest(spark, sf)
    found = c.sql(q_merkle.SQL)
    at = [found.columns.index(x) for x in df.columns]
    rows = sorted(map(tuple, df.collect()))
    assert rows == sorted(tuple(r[i] for i in at) for r in found.fetchall())
    assert 0 < sum(r[-1] for r in rows) < len(rows)
