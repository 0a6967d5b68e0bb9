"""Every query with SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from gridsift.plans import gallery_queries
from gridsift.plans.registry import ORACLES, QUERIES

assert gallery_queries


def plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    found = db.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(found.columns)
    at = [found.columns.index(c) for c in sorted(found.columns)]
    rows = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
