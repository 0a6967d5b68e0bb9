"""Query of the licence scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import licenses
from .session import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text_digest, license_id, license_kind of every document.

    A null or empty text has no licence; equal texts get equal rows; an empty table gives no rows; other columns of
    documents are not read.
    """
    return licenses.license_scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    hint = " OR ".join(f"contains(low, {quote(h)})" for h in licenses._HINTS)
    one = "bare"
    for a, b in licenses.EQUIVALENT.items():
        one = f"replace({one}, {quote(a)}, {quote(b)})"
    canon = lambda src: f"SELECT *, trim(regexp_replace({one}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS canon FROM (SELECT *, CASE WHEN {hint} THEN regexp_replace(low, {quote("(?m)" + licenses.COPYRIGHT_LINE)}, chr(10), 'g') ELSE low END AS bare FROM (SELECT *, lower(coalesce(text, '')) AS low FROM {src}))"
    rows = ", ".join(f"({i}, {quote(a)}, {quote(k)}, {quote(t)})" for i, (a, k, t) in enumerate(licenses.KNOWN))
    return f"""
WITH known AS (SELECT sha256(canon) AS digest, arg_min(license_id, r) AS license_id, arg_min(license_kind, r) AS license_kind
               FROM ({canon(f"(SELECT * FROM (VALUES {rows}) v(r, license_id, license_kind, text))")}) WHERE canon <> '' GROUP BY 1),
d AS (SELECT doc_id, sha256(canon) AS text_digest FROM ({canon("documents")}))
SELECT doc_id, text_digest, license_id, license_kind FROM d LEFT JOIN known ON digest = text_digest"""


QUERIES = {"op1_license_scan": op1_license_scan}
ORACLES = {"op1_license_scan": _sql()}
