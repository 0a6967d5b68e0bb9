"""A training-corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``.
run() writes each stage's result as Parquet in the shared folder and reads it again as the next one's input.

Rows are told apart by doc_id and a hash of their text, so null or repeated doc_ids do not make one row's verdict
another's. Of rows that agree in both, the deduplicating stage keeps one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsift.llm import bpe, classifier, decontamination, jaccard, quality_rules
from gridsift.llm.session import small_batches, staged, table

#: Most rejected rows that are broadcast (about 32 bytes each); more are taken out by a shuffled join.
BROADCAST_ROWS = 1_000_000


def _without(docs: DataFrame, rejected: DataFrame, name: str) -> DataFrame:
    """``docs`` without the rows that ``rejected`` (doc_id, text_hash) names."""
    return _matched(docs, staged(rejected.select("doc_id", "text_hash").distinct(), name), "left_anti")


def _matched(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """``docs`` joined by ``how`` to the staged distinct ``rows`` (doc_id, text_hash)."""
    rows = rows.select(F.col("doc_id").alias("_r_id"), F.col("text_hash").alias("_r_hash"))
    side = F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows
    return docs.join(side, F.col("doc_id").eqNullSafe(F.col("_r_id")) & (F.xxhash64("text") == F.col("_r_hash")), how)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    small_batches(spark)
    scored = classifier.quality_scores(docs.withColumn("text_hash", F.xxhash64("text")), table(spark, sf_dir, "labels"), carry=("text_hash",))
    return _without(docs, scored.where(~F.col("kept")), "rejected-classifier")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    judged = quality_rules.quality_rules(docs.withColumn("text_hash", F.xxhash64("text")), carry=("doc_id", "text_hash"))
    return _without(docs, judged.where(~F.col("kept")), "rejected-rules")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies: the first by doc_id, nulls last, then by the text's hash.

    Rows without words are no one's copies. Repeated rows of one doc_id and text become one.
    """
    small_batches(spark)
    found = staged(jaccard.jaccard_firsts(docs), "firsts")
    rest = _without(docs, found.where(~F.col("first")), "copies")
    again = staged(found.where("first").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "repeated-rows")
    if not again.head(1):
        return rest
    return _matched(rest, again, "left_anti").unionByName(_matched(rest, again, "left_semi").dropDuplicates(["doc_id", "text"]))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    small_batches(spark)
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (little-endian unsigned 32-bit) and the digests of ids and of the text they spell."""
    small_batches(spark)
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), vocabulary).select(
        "doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("BPE encoding and decoding", encode),
]

#: The classifier's fit and the alignments are not SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
