"""Query of the quality classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import classifier
from .session import small_batches, table


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, p_document, p_host, p_path, score and kept of every document; hosts are sources, their paths languages."""
    small_batches(spark)
    rows = classifier.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "p_document", "p_host", "p_path", "score", "kept")


QUERIES = {"op6_quality_classifier": op6_quality_classifier}
ORACLES: dict = {}
