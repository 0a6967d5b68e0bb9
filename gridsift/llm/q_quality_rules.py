"""Query of the quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import quality_rules
from .session import table


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the counts of the base rules, base_failed and kept of every document.

    A null or empty text has no words, so base_failed is true; null lang and source are groups of their own (''); equal
    rows get equal verdicts; an empty table gives no rows; other columns of documents are not read.
    """
    rows = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def verdict_sql(documents: str = "documents") -> str:
    """DuckDB SQL for op2_quality_rules' rows (doc_id is a key of the table)."""
    metric = quality_rules.METRICS
    hi = " AND ".join(f"coalesce(m_{m} <= hi_{m}, true)" for m in metric) + "".join(f" AND coalesce(m_{m} >= lo_{m}, true)" for m, (_, both) in metric.items() if both)
    least = "CASE metric " + " ".join(f"WHEN '{m}' THEN {s}" for m, (s, _) in metric.items()) + " END"
    limits = ", ".join(f"max(CASE WHEN metric = '{m}' THEN hi END) AS hi_{m}, max(CASE WHEN metric = '{m}' THEN lo END) AS lo_{m}" for m in metric)
    w, k, o = quality_rules.WEIGHT, quality_rules.SPREADS, quality_rules.OUTER
    long = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, m_{m} AS v FROM m" for m in metric)
    quart = lambda keys, src: f"SELECT {keys}metric, max(docs) AS docs, min(CASE WHEN 4 * upto >= docs THEN value END) AS q25, min(CASE WHEN 4 * upto >= 3 * docs THEN value END) AS q75 FROM (SELECT *, sum(n) OVER (PARTITION BY {keys}metric ORDER BY value) AS upto, sum(n) OVER (PARTITION BY {keys}metric) AS docs FROM (SELECT {keys}metric, value, sum(n) AS n FROM {src} GROUP BY ALL)) GROUP BY ALL"
    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM {documents}),
s AS (SELECT *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
w AS (SELECT doc_id, unnest(words) AS w, unnest(range(len(words))) AS i FROM s),
g AS (SELECT doc_id, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS g FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g WHERE g IS NOT NULL) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(5) r(k) GROUP BY doc_id),
f AS (SELECT s.doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
      CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(length(text) - length(replace(text, '!', '')) AS BIGINT) AS n_bangs, CAST(len(lines) AS BIGINT) AS n_lines,
      CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
      FROM s LEFT JOIN covered USING (doc_id)),
m AS (SELECT *, CASE WHEN word_chars > 0 THEN CAST(floor(n_symbols * 1000 / word_chars) AS BIGINT) END AS m_symbols,
      CASE WHEN n_lines > 0 THEN CAST(floor(n_dup_lines * 1000 / n_lines) AS BIGINT) END AS m_dup_lines,
      CASE WHEN n_words > 0 THEN CAST(floor(n_repeat_words * 1000 / n_words) AS BIGINT) END AS m_repeats,
      CASE WHEN n_words > 0 THEN CAST(floor(word_chars * 100 / n_words) AS BIGINT) END AS m_word_length,
      CASE WHEN n_words > 0 THEN CAST(floor(n_bangs * 1000 / n_words) AS BIGINT) END AS m_bangs FROM f),
sketch AS (SELECT lang, source, metric, (v >> z) << z AS value, count(*) AS n
           FROM (SELECT *, greatest(0, length(bin(v)) - 6) AS z FROM ({long}) WHERE v IS NOT NULL) GROUP BY ALL),
own AS ({quart("lang, source, ", "sketch")}), by_lang AS ({quart("lang, ", "sketch")}), whole AS ({quart("", "sketch")}),
q AS (SELECT o.lang, o.source, o.metric, o.docs, o.q25::DOUBLE AS o25, o.q75::DOUBLE AS o75,
      (l.docs * l.q25 + {w} * a.q25)::DOUBLE / (l.docs + {w}) AS q25_l, (l.docs * l.q75 + {w} * a.q75)::DOUBLE / (l.docs + {w}) AS q75_l
      FROM own o JOIN by_lang l ON o.lang = l.lang AND o.metric = l.metric JOIN whole a ON o.metric = a.metric),
q2 AS (SELECT *, (docs * o25 + {w} * q25_l) / (docs + {w}) AS q25, (docs * o75 + {w} * q75_l) / (docs + {w}) AS q75 FROM q),
q3 AS (SELECT *, {k} * greatest(q75_l - q25_l, {least}) AS d_l, {k} * greatest(q75 - q25, {least}) AS d FROM q2),
q4 AS (SELECT lang, source, metric, round(least(q75 + d, q75_l + {o} * d_l), 6) AS hi, round(greatest(q25 - d, q25_l - {o} * d_l), 6) AS lo FROM q3),
lim AS (SELECT lang, source, {limits} FROM q4 GROUP BY lang, source),
v AS (SELECT m.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, ({hi}) AS inside FROM m LEFT JOIN lim USING (lang, source))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND inside AS kept FROM v"""


QUERIES = {"op2_quality_rules": op2_quality_rules}
ORACLES = {"op2_quality_rules": verdict_sql()}
