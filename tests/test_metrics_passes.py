"""Ranking metrics read their rows once."""

import pytest
from pyspark.sql import functions as F

from gridsift.operators import metrics


@pytest.mark.parametrize("f", [metrics.ranking_metrics, metrics.aupro])
def test_rows_are_read_once(spark, f):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(3000).select((F.col("id") % 2).alias("k"), (F.col("id") * 7 % 100 / 100).alias("score"), F.when(F.col("id") % 3 == 0, F.col("id") % 5).alias("region_id"), (F.col("id") % 4 == 0).alias("target"))
    assert f(rows.mapInArrow(count, rows.schema), ["k"]).count() == 2
    assert seen.value == 3000
