"""The shared folder: the configured one, else a temporary one under a local master only."""

from types import SimpleNamespace

import pytest

from gridsift.sources import shared


def session(master, **conf):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k.replace(".", "_"), d)), sparkContext=SimpleNamespace(master=master))


def test_shared_root():
    assert shared.shared_root(session("yarn", spark_checkpoint_dir="hdfs:///x/")) == "hdfs:///x"
    assert shared.shared_root(session("local[4]")).startswith("file://")
    assert shared.shared_root(session("yarn", spark_sql_warehouse_dir="s3a://b/w")) == "s3a://b/w"
    for local in ("file:/tmp/w", "/tmp/w"):
        with pytest.raises(ValueError):
            shared.shared_root(session("yarn", spark_sql_warehouse_dir=local))
