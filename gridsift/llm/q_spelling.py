"""Query of the spelling variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import spelling
from .q_merkle import crc32_sql
from .session import table
from .urls import LOWER, UPPER


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near and form_n of the words of at least 6 code points with 5 occurrences; a run whose checksum 199 divides has lost a letter."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), damage=199)


_BYTES = "flatten(list_transform(string_split(doc_id::VARCHAR || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195::BIGINT, ord(c)::BIGINT - 64] END))"
SQL = rf"""
WITH RECURSIVE r AS (SELECT doc_id, translate(x, '{UPPER}', '{LOWER}') AS run, count(*) AS k
     FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS x FROM documents) GROUP BY ALL),
h AS MATERIALIZED (SELECT run, k, {crc32_sql(_BYTES)} AS h FROM r WHERE length(run) >= 6),
w AS MATERIALIZED (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(k)::BIGINT AS n
     FROM h GROUP BY 1 HAVING sum(k) >= 5 AND length(word) >= 6),
d AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS v FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
p AS MATERIALIZED (SELECT a.word, b.word AS near, b.n AS n_of FROM d a JOIN d b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
     UNION SELECT a.word, b.word, b.n FROM d a JOIN w b ON a.v = b.word UNION SELECT b.word, a.word, a.n FROM d a JOIN w b ON a.v = b.word),
q AS (SELECT word, near, n_of, row_number() OVER (PARTITION BY word ORDER BY n_of DESC, encode(near)) AS rank, count(*) OVER (PARTITION BY word) AS n_near FROM p),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN n_of >= 5 * w.n THEN near END AS form, CASE WHEN n_of >= 5 * w.n THEN n_of END AS form_n FROM w LEFT JOIN q ON w.word = q.word AND rank = 1),
c AS (SELECT word, word AS at FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON c.at = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM f JOIN c ON f.word = c.word JOIN f e ON c.at = e.word AND e.form IS NULL"""

QUERIES = {"op13_spelling_variants": op13_spelling_variants}
ORACLES = {"op13_spelling_variants": SQL}
