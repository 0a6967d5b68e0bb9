"""Query of the benchmark decontamination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontamination
from .session import small_batches, table


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, score, start_byte, end_byte of the documents that hold a copy of a test item, edited or not."""
    small_batches(spark)
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op8_decontamination": op8_decontamination}
ORACLES: dict = {}
