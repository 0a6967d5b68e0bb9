"""Query of the n-gram Jaccard join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import jaccard
from .session import small_batches, table


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every document: classes of texts linked by Jaccard 0.8 of five-word shingles."""
    small_batches(spark)
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents"))


QUERIES = {"op3_ngram_jaccard_join": op3_ngram_jaccard_join}
ORACLES: dict = {}
