"""Query of the Merkle manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import merkle
from .session import table
from .urls import LOWER, UPPER


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document.

    Texts of documents where 5 divides the CRC-32 of the decimal doc_id are tampered with: A-Z become lower-case.
    """
    text = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.translate("text", UPPER, LOWER))
    rows = merkle.document_manifest(table(spark, sf_dir, "documents"), text)
    rows = rows.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest().alias("proof_sha256"), merkle.folded(F.col("claimed")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def crc32_sql(codes: str) -> str:
    """DuckDB SQL of the CRC-32 of a list of byte values; its table follows from the polynomial."""
    lookup = []
    for i in range(256):
        for _ in range(8):
            i = (i >> 1) ^ (0xEDB88320 if i & 1 else 0)
        lookup.append(i)
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda a, b: xor(a >> 8, ({lookup}::BIGINT[])[(xor(a, b) & 255) + 1])), 4294967295::BIGINT)"


#: Levels that the SQL spells out; a tree of fewer passes through the rest unchanged.
_LEVELS = 5


def _tree(name: str, start: str, carried: str) -> str:
    """Level by level: each node's run of 16 as a list of digests; a group that is down to one node stays as it is."""
    out = f"{name}0 AS ({start}),\n"
    left, right = "array_to_string(ds[1:(i % 16)], '')", "array_to_string(ds[(i % 16) + 2:], '')"
    for k in range(_LEVELS):
        out += f"""{name}r{k} AS (SELECT g AS rg, i // 16 AS b, list(d ORDER BY i) AS ds FROM (SELECT DISTINCT g, i, d FROM {name}{k}) GROUP BY ALL),
{name}{k + 1} AS (SELECT {carried}, g, i // 16 AS i, (n + 15) // 16 AS n, CASE WHEN n > 1 THEN sha256(array_to_string(ds, '')) ELSE d END AS d,
     CASE WHEN n > 1 THEN sha256({left} || f || {right}) ELSE f END AS f, CASE WHEN n > 1 THEN p || {left} || {right} ELSE p END AS p FROM {name}{k} JOIN {name}r{k} ON g = rg AND i // 16 = b),
"""
    return out.rstrip()


def _sql() -> str:
    part = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    head = " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars"))
    crc = crc32_sql("list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)")
    return f"""
WITH c AS (SELECT *, CASE WHEN {crc} % 5 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END AS other FROM documents),
l AS (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE 's' || source END AS g, sha256({head} || {part('text')}) AS leaf, sha256({head} || {part('other')}) AS claimed FROM c),
{_tree('a', "SELECT doc_id, leaf, claimed, g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n, leaf AS d, claimed AS f, '' AS p FROM l", 'doc_id, leaf')}
s AS (SELECT DISTINCT g AS source, d FROM a{_LEVELS}),
{_tree('b', "SELECT source, d AS subroot, '' AS g, row_number() OVER (ORDER BY encode(source)) - 1 AS i, count(*) OVER () AS n, d, '' AS f, '' AS p FROM s", 'source, subroot')}
docs AS (SELECT doc_id, leaf, s0.d AS subroot, s0.f, s0.p AS own, u.p AS above, u.d AS root, s0.g FROM a{_LEVELS} s0 JOIN b{_LEVELS} u ON u.source = s0.g),
{_fold()}
SELECT doc_id, leaf, subroot, root, sha256(own || above) AS proof_sha256, f AS folded_root, f = root AS verified FROM e{_LEVELS}"""


def _fold() -> str:
    """The tampered digests go up the second tree beside the true ones."""
    out = "e0 AS (SELECT doc_id, leaf, subroot, root, own, above, g AS source, f FROM docs),\n"
    for k in range(_LEVELS):
        out += (
            f"e{k + 1} AS (SELECT doc_id, leaf, e.subroot, root, own, above, e.source, CASE WHEN n > 1 THEN sha256(array_to_string(ds[1:(i % 16)], '') || e.f || array_to_string(ds[(i % 16) + 2:], '')) ELSE e.f END AS f "
            f"FROM e{k} e JOIN b{k} t ON t.source = e.source JOIN br{k} r ON t.i // 16 = r.b),\n"
        )
    return out.rstrip(",\n")


SQL = _sql()
QUERIES = {"op11_merkle_manifest": op11_merkle_manifest}
ORACLES = {"op11_merkle_manifest": SQL}
