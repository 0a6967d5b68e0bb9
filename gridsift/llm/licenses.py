"""Licence scans: whole texts in canonical form, hash-joined to the digests of known licences. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import EQUIVALENT, KNOWN

#: Lines that name a holder, not a licence: after comment marks, 'copyright' with '(c)', the sign, a digit or a kind of holder at the line's end; '(c)' with a year, the sign, or 'all rights reserved'.
COPYRIGHT_LINE = (
    r"(^|\n)[ \t#*/;.-]*(copyright (\(c\)|©|[0-9])[^\n]*|(\(c\) ?(copyright|[0-9])|©|all rights reserved)[^\n]*"
    r"|copyright [^\n]*(authors|contributors|developers|foundation|inc\.?|ltd\.?|llc|gmbh|project|team)[ \t\r]*$)"
)
_HINTS = ("copyright", "(c)", "©", "all rights reserved")


def canonical(text: str | Column) -> Column:
    """The text in lower case without copyright lines, in one spelling, with single spaces for punctuation and white space.

    A null text is as an empty one. Only texts that hold a hint of a copyright line go through that pattern.
    """
    low = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    hint = reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in _HINTS])
    bare = F.when(hint, F.regexp_replace(low, "(?dm)" + COPYRIGHT_LINE, "\n")).otherwise(low)
    one = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), EQUIVALENT.items(), bare)
    return F.trim(F.regexp_replace(one, r"[^\p{L}\p{N}]+", " "))


def digest(text: str | Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known_digests(spark: SparkSession, known: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """license_digest, license_id, license_kind, one row for each digest (texts that agree once canonical: the first id)."""
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(KNOWN if known is None else known)], "rank int, license_id string, license_kind string, text string")
    rows = rows.withColumn("license_digest", digest("text")).where(canonical("text") != "")
    first = F.min_by(F.struct("license_id", "license_kind"), "rank")
    return rows.groupBy("license_digest").agg(first.alias("x")).select("license_digest", "x.license_id", "x.license_kind")


def license_scan(df: DataFrame, known: list[tuple[str, str, str]] | None = None, text: str = "text") -> DataFrame:
    """Append text_digest, license_id and license_kind ('text' or 'notice') to each row of ``df``.

    The ids are null where the whole text is no known licence; an empty or null text never is one. Existing columns
    so named are replaced. The known digests are one row for each licence text given here, so they are broadcast;
    documents are never shuffled, whatever their copies.
    """
    new = ("text_digest", "license_id", "license_kind")
    rows = df.select(*[c for c in df.columns if c not in new], digest(text).alias("text_digest"))
    codes = known_digests(df.sparkSession, known).withColumnRenamed("license_digest", "_l_digest")
    return rows.join(F.broadcast(codes), F.col("text_digest") == F.col("_l_digest"), "left").drop("_l_digest")
