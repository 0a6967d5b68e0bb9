"""Exact duplicates: counting quotient filters find fingerprints that repeat, and the bytes of their texts decide.

1. One pass over the texts stages (doc_id, 64-bit fingerprint, SHA-256) of each row.
2. Each task turns its fingerprints into counting quotient filters, one for each segment (the fingerprint's first bits);
   the filters of a segment are merged by their sorted remainders. A fingerprint of one row is a text without copies.
3. Texts whose fingerprint counts more than one are grouped by their bytes, which Spark combines before the shuffle, so
   a text with any number of copies sends one row a task. Texts that share a fingerprint and differ part here.
4. Groups go back to the rows by fingerprint and digest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import quotient
from .session import staged

#: Fingerprints of one merged filter, about.
SEGMENT = 1 << 20
#: Fingerprints that a task holds before it writes filters (8 bytes each).
HELD = 4 << 20
#: Most keys that are broadcast (at most some 100 bytes each); more are joined by a shuffle, but for hot ones.
BROADCAST_ROWS = 500_000
#: A key of more than 1 / HOT of all rows is hot; there are fewer than HOT of them, so these are always broadcast.
HOT = 1000


def _fingerprint(text, bits: int):
    return F.xxhash64(text).bitwiseAND(F.lit(-1 << (64 - bits)))


def repeated_fingerprints(rows: DataFrame, column: str = "fp", total: int | None = None) -> DataFrame:
    """fp, n (longs): the values of ``column`` that more than one of ``rows`` has, by merged counting quotient filters.

    ``total`` is the number of rows, if known. Nulls are left out.
    """
    total = rows.count() if total is None else total
    high = max(0, -(-total // SEGMENT) - 1).bit_length()
    bits = 64 - high

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            size += len(held[-1])
            if size >= HELD:
                yield filters(np.concatenate(held))
                held, size = [], 0
        if size:
            yield filters(np.concatenate(held))

    def filters(x: np.ndarray) -> pa.RecordBatch:
        x, n = np.unique(x, return_counts=True)
        segment = (x >> np.uint64(bits)).astype(np.int64) if high else np.zeros(len(x), np.int64)
        low = x & np.uint64((1 << bits) - 1)
        cut = np.flatnonzero(np.diff(segment, prepend=-1, append=-1))
        made = [quotient.build(low[a:b], n[a:b], bits) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(segment[cut[:-1]]), pa.array(made, pa.binary())], ["segment", "filter"])

    def merged(key: tuple, pieces: pa.Table) -> pa.Table:
        x, n = quotient.items(quotient.merge(pieces.column("filter").to_pylist(), bits))
        full = x[n > 1] | np.uint64((key[0].as_py() << bits) if high else 0)
        return pa.table({"fp": pa.array(full.view(np.int64)), "n": pa.array(n[n > 1])})

    pieces = rows.where(F.col(column).isNotNull()).select(F.col(column).cast("long").alias("fp")).mapInArrow(segments, "segment long, filter binary")
    return pieces.groupBy("segment").applyInArrow(merged, "fp long, n long")


def _matched(rows: DataFrame, keys: DataFrame, on: list[str], size: str, total: int, how: str) -> DataFrame:
    """``rows`` joined (left or left_semi) to staged ``keys``; hot keys (by their ``size``) are broadcast, all of them if few."""
    if keys.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(keys), on, how)
    hot = F.broadcast(keys.where(F.col(size) * HOT > total))
    cold = rows.join(hot.select(*on), on, "left_anti").join(keys.where(F.col(size) * HOT <= total), on, how)
    return rows.join(hot, on, "inner" if how == "left" else how).unionByName(cold)


def exact_dedup(docs: DataFrame, fingerprint_bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of ``docs`` (doc_id, text; other columns are not read).

    Rows are copies when their texts have the same bytes; a null text counts as empty, whatever else is empty or null is
    a text like any other. The row with the largest doc_id stays; nulls come last, and of repeated rows with one doc_id
    and text exactly one stays. keep_id is null only if all of a group's doc_ids are. An empty table gives no rows. Two
    different texts with one SHA-256, of which none are known, raise an error.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _fingerprint(text, fingerprint_bits).alias("fp"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), F.monotonically_increasing_id().alias("seq"))
    own = staged(own, "fingerprints")
    total = own.count()
    repeated = staged(repeated_fingerprints(own, total=total), "repeated-fingerprints")

    texts = _matched(docs.select(text.alias("text"), _fingerprint(text, fingerprint_bits).alias("fp")), repeated, ["fp"], "n", total, "left_semi")
    texts = texts.groupBy("fp", "text").agg(F.count("*").alias("n"))  # the bytes themselves
    proved = texts.select("fp", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), "n").groupBy("fp", "digest").agg(F.count("*").alias("texts"), F.sum("n").alias("proved"))

    best = F.max(F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", "seq")).alias("best")
    found = _matched(own, repeated, ["fp"], "n", total, "left_semi").groupBy("fp", "digest").agg(best, F.count("*").alias("group_size"))
    wrong = (F.col("texts") != 1) | (F.col("proved") != F.col("group_size"))
    size = F.when(wrong, F.raise_error(F.lit("texts of one digest differ")).cast("long")).otherwise(F.col("group_size"))
    classes = staged(found.join(proved, ["fp", "digest"]).select("fp", "digest", F.col("best.doc_id").alias("keep_id"), F.col("best.seq").alias("keep_seq"), size.alias("group_size")).where("group_size > 1"), "copies")

    rows = _matched(own, classes, ["fp", "digest"], "group_size", total, "left")
    alone = F.col("group_size").isNull()
    return rows.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("seq") == F.col("keep_seq"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )
