"""Query of the WARC round trip."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import warc
from .session import small_batches, stage_path, table


def op5_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC archives and read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    small_batches(spark, 512)
    path = stage_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    page = lambda c: F.regexp_extract(c, r"^urn:gridsift:(-?\d+):", 1).try_cast("long")
    rows = warc.read_warc(spark, path)
    checked = F.when(F.col("valid"), F.col("payload_bytes")).otherwise(F.raise_error("a record is damaged").cast("long"))
    return rows.select(page("record_id").alias("page_id"), checked.alias("payload_bytes"), "payload_digest", "record_type", page("refers_to").alias("refers_to"))


_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex FROM p),
d AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS last FROM h)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((CAST('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31), 1)), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to FROM d"""

QUERIES = {"op5_warc_segments": op5_warc_segments}
ORACLES = {"op5_warc_segments": _SQL}
