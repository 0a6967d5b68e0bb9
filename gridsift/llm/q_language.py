"""Query of the language ID."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language
from .session import small_batches, table


def op10_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_switches and a digest of the spans of every document; documents held out are never learned from."""
    small_batches(spark, 2048)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out.alias("held_out"))
    model = language.trained(docs.where(~F.col("held_out")))
    found = language.identify(docs, model, carry=("doc_id", "held_out"))
    placed = F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["lang"].alias("lang")))
    return found.withColumn("n_switches", F.greatest(F.size("spans") - 1, F.lit(0)).cast("long")).withColumn("spans_sha256", F.sha2(F.to_json(placed), 256)).drop("spans")


QUERIES = {"op10_language_crf": op10_language_crf}
ORACLES: dict = {}
