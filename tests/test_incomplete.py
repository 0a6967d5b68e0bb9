"""Queries over images whose grids lack cells, against their SQL."""

import os

import duckdb
import pytest

from gridsift.plans.registry import ORACLES, QUERIES

from .test_queries import plain

NAMES = ["f5_morph_open", "f6_morph_close", "k1_extract_features", "e26_mean_pairwise_similarity", "g16_upsample_map", "g2_box_smooth", "h1_memory_bank", "j1_stream_anomaly_scores"]


@pytest.fixture(scope="module")
def holes(sf, tmp_path_factory):
    """The embeddings with holes, an image that ends early, and one of a single patch."""
    folder = tmp_path_factory.mktemp("holes")
    rows = f"SELECT * FROM '{sf}/embeddings.parquet'"
    duckdb.sql(f"COPY ({rows} WHERE vec_id % 37 <> 5 AND vec_id % 100 NOT IN (44, 45, 54, 55) AND vec_id < 456 UNION ALL SELECT 730, embedding, label FROM ({rows}) WHERE vec_id = 1) TO '{folder}/embeddings.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, holes, name):
    c = duckdb.connect()
    for f in os.listdir(holes):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{holes}/{f}'")
    df, found = QUERIES[name](spark, holes), c.sql(ORACLES[name])
    order = sorted(df.columns)
    assert order == sorted(found.columns)
    at = [found.columns.index(k) for k in order]
    rows = sorted((tuple(plain(r[k]) for k in order) for r in df.collect()), key=repr)
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
