"""Licence scans, quality rules and URL filters: against DuckDB, plain Python and on edge cases."""

import os
import random
import re

import duckdb
import pytest

from gridsift.llm import components, license_texts, licenses, q_licenses, q_quality_rules, q_urls, q_warc, quality_rules, urls

from gridsift.llm.session import Scratch

WORD = r"[^\x20\x09-\x0D]+"


@pytest.mark.parametrize("module", [q_licenses, q_quality_rules, q_urls, q_warc])
def test_same_rows_as_duckdb(spark, sf, module):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    for name, f in module.QUERIES.items():
        df = f(spark, sf)
        found = c.sql(module.ORACLES[name])
        at = [found.columns.index(x) for x in df.columns]
        assert sorted(map(tuple, df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=repr)


def test_native_plans_have_no_python(spark, sf):
    for f in (q_licenses.op1_license_scan, q_quality_rules.op2_quality_rules, q_urls.op9_url_filter):
        plan = f(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_license_forms(spark):
    mit = license_texts.KNOWN[0][2]
    rows = [
        (1, "Copyright (c) 2020 Somebody\nAll rights reserved.\n\n" + mit.upper().replace(" ", "  \n")),
        (2, "// Copyright 1999 A, B\n" + mit.replace("Permission is hereby", "“Permission” is, hereby")),
        (2, "# Copyright The Foo Authors\n# Copyright Bar, Inc.\n" + mit), (9, license_texts._FILES["GPL-3.0"].replace("\n", "\r\n")), (10, license_texts._FILES["Apache-2.0"].replace("\n", " ")), (11, "Copyright 2020 X\n" + license_texts._UNLICENSE.lower()),
        (3, mit + " extra"), (4, None), (5, ""), (6, "Licensed under the APACHE Licence, version 2.0"), (6, "Licensed under the APACHE Licence, version 2.0"), (7, "© 2020\n"), (8, "x " * 200_000),
    ]
    df = spark.createDataFrame([(*r, "old", 0) for r in rows], "doc_id long, text string, license_id string, rank int")
    got = licenses.license_scan(df).collect()
    assert len(got) == len(rows) and sorted((r.doc_id, r.license_id) for r in got if r.license_id) == [(1, "MIT"), (2, "MIT"), (2, "MIT"), (6, "Apache-2.0"), (6, "Apache-2.0"), (9, "GPL-3.0"), (10, "Apache-2.0"), (11, "Unlicense")]
    assert {r.license_kind for r in got} == {None, "text", "notice"} and "rank" in got[0].asDict()
    assert licenses.license_scan(df.limit(0)).count() == 0 and licenses.license_scan(df, []).where("license_id IS NOT NULL").count() == 0


def plain_features(t):
    w = re.findall(WORD, t or "")
    g = {}
    for i in range(len(w) - 4):
        g.setdefault(tuple(w[i : i + 5]), []).append(i)
    lines = [x for x in (t or "").split("\n") if re.search(WORD, x)]
    covered = {i + k for at in g.values() if len(at) > 1 for i in at for k in range(5)}
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_features_against_plain_python(spark):
    rng = random.Random(1)
    texts = [None, "", " \t\n\x0b\x0c\r ", "a", "a b c d e a b c d e", "a b c d e f\na b c d e f\n\n \n x", "é😀 #* |\n" * 3, "aa aa aa aa aa aa aa", "w " * 30_000]
    texts += [" ".join(rng.choices("ab", k=rng.randint(1, 40))) + rng.choice(["", "\n"]) * 2 for _ in range(80)]
    df = spark.createDataFrame([(i, t, None, "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_words int")
    for r in quality_rules.features(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_features(texts[r.doc_id])
    got = quality_rules.quality_rules(df).collect()
    assert len(got) == len(texts) and all(r.base_failed != (r.n_words >= 10 and 100 * r.n_repeat_words <= 20 * r.n_words) and not (r.kept and r.base_failed) for r in got)
    assert quality_rules.quality_rules(df.limit(0)).count() == 0


def test_fences_follow_the_group(spark):
    clean = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"
    noisy = " ".join(f"{w}#" if i % 3 == 0 else w for i, w in enumerate(clean.split()))
    rows = [(i, clean, "en", "plain") for i in range(1500)] + [(3000 + i, noisy, "en", "marked") for i in range(1500)] + [(2000, noisy, "en", "plain"), (2001, noisy, None, None), (2001, noisy, None, None)]
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[0] and got[3000] and not got[2000]


@pytest.mark.parametrize("size", [50, 99, 100, 2000])
def test_a_source_of_spam_cannot_set_itself_free(spark, size):
    clean = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"
    spam = " ".join(f"{w}####" for w in clean.split())
    rows = spark.range(8000).selectExpr("id AS doc_id", f"'{clean}' AS text", "'en' AS lang", "concat('s', id % 5) AS source")
    rows = rows.unionByName(spark.range(10_000, 10_000 + size).selectExpr("id AS doc_id", f"'{spam}' AS text", "'en' AS lang", "'spam' AS source"))
    assert {(r.source == "spam", r.kept) for r in quality_rules.quality_rules(rows, carry=("doc_id", "source")).select("source", "kept").distinct().collect()} == {(True, False), (False, True)}


def test_salted_fences_give_the_same(spark, sf, monkeypatch):
    rows = lambda: sorted(map(tuple, q_quality_rules.op2_quality_rules(spark, sf).collect()))
    want = rows()
    monkeypatch.setattr(quality_rules, "BROADCAST_GROUPS", 0)
    assert rows() == want


def test_url_rules_against_plain_python(spark):
    rules = q_urls.RULES | {"deep.example.net/en/x": "block"}
    given = [
        None, "", "no scheme", "http://", "http://A.NET/", "http://a.net", "http://net/", "http://notnet/x", "https://www.EXAMPLE.net/en/1?x=http://b.org/fr/", "http://example.net/EN/",
        "ftp://deep.example.net/en/x/y#z", "http://m.example.com/de/5", "http://m.example.com/de", "http://org/fr/é", "http://x.org?/fr/", "http://h.net:80/p", "a://b://c/d", "http://\n.net/\n/x", "http://x.y/" + "s/" * 3000,
    ]

    def plain(u):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        h, p = ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
        fit = [r for r in rules if (h == r.split("/")[0] or h.endswith("." + r.split("/")[0])) and p.startswith("/" + r.split("/", 1)[1])]
        return h, p, max(fit, key=len, default=None)

    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(given * 2)], "page_id long, url string, host string")
    got = urls.url_filter(df, rules).collect()
    assert len(got) == 2 * len(given)
    for r in got:
        assert (r.host, r.path, r.rule) == plain(given[r.page_id % len(given)])
        assert r.verdict == rules[r.rule] if r.rule else r.verdict in ("allow", "block")
    assert urls.url_filter(df.limit(0), rules).count() == 0 and urls.url_filter(df, {}).where("verdict = 'block'").count() == 0


def tree_of(spark, rows):
    with Scratch(spark) as scratch:
        return {(r.host, r.lexical): r for r in urls.template_tree(spark.createDataFrame(rows, "host string, lexical string, label string"), scratch).collect()}


def test_templates_merge_level_by_level_and_inherit_purity(spark):
    rows = [("a.h.com", f"{c}/x/{k}", "block") for c in "pq" for k in range(6)] + [("a.h.com", f"{c}/y/{k}", "allow") for c in "pq" for k in range(6)]
    rows += [("a.h.com", "r/x/1", None), ("a.h.com", "p/x/9", None), ("a.h.com", "p/y/9", None), ("a.h.com", "q/z/1", None)]
    got = tree_of(spark, rows)
    assert got["a.h.com", "p/x/1"].template == got["a.h.com", "q/x/3"].template == "*/x/*" and got["a.h.com", "p/y/1"].template == "*/y/*"
    assert got["a.h.com", "r/x/1"].template == "r/x/1" and got["a.h.com", "p/x/9"].template == "*/x/9"
    assert got["a.h.com", "p/x/9"].purity > urls.PURITY > 0.5 > got["a.h.com", "p/y/9"].purity
    assert got["a.h.com", "p/y/9"].purity < got["a.h.com", "q/z/1"].purity < got["a.h.com", "p/x/9"].purity


@pytest.mark.parametrize("branches", [1, 7, 8, 50])
def test_one_bad_branch_does_not_reject_its_siblings_but_a_bad_domain_does(spark, branches):
    good = [("good.org", f"s{k}/1", "allow") for k in range(40)]
    rows = [("x.one.com", "bad/1", "block")] * 30 + [("x.one.com", f"s{k}/1", None) for k in range(branches)]
    got = tree_of(spark, rows + good)
    assert got["x.one.com", "bad/1"].purity >= urls.PURITY and all(got["x.one.com", f"s{k}/1"].purity < urls.PURITY for k in range(branches))
    rows = [(f"h{h}.all.com", "bad/1", "block") for h in range(12) for _ in range(30)] + [("new.all.com", f"s{k}/1", None) for k in range(branches)]
    got = tree_of(spark, rows + good)
    assert all(got["new.all.com", f"s{k}/1"].purity >= urls.PURITY for k in range(branches)) and got["good.org", "s1/1"].purity < urls.PURITY


def test_pages_without_a_rule_get_both_verdicts(spark):
    found = {(r.rule, r.verdict) for r in q_urls.op9_url_filter(spark, "/root/testdata/sf0.01").collect() if r.rule is None}
    assert found == {(None, "allow"), (None, "block")}


def test_components_against_union_find(spark):
    rng = random.Random(2)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(160)] + [(1000 + i, 1000 + i + 1) for i in range(60)] + [(2000, 2001 + i) for i in range(200)] + [(5, 5), (None, 3), (7, None)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            up[max(root(a), root(b))] = min(root(a), root(b))
    want = sorted((x, root(x)) for x in list(up) if any(x in p and p[0] != p[1] and None not in p for p in links))
    assert sorted(map(tuple, components.components(spark.createDataFrame(links, "a long, b long")).collect())) == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
