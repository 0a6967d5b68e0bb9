"""Query of the BPE automaton: ids and decoded texts of all documents, as digests."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .session import small_batches, table


def op7_bpe_automaton(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text (null: empty)."""
    small_batches(spark)
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    return bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


QUERIES = {"op7_bpe_automaton": op7_bpe_automaton}
ORACLES: dict = {}
