"""Query of exact deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup
from .session import table


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every document (null text: empty)."""
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)"""

QUERIES = {"op12_exact_dedup": op12_exact_dedup}
ORACLES = {"op12_exact_dedup": SQL}
