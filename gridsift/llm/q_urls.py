"""Query of the URL filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import urls
from .session import table

RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    A null or malformed URL has an empty host and path and no rule; equal URLs get equal verdicts; an empty table gives
    no rows; other columns of pages are not read.
    """
    rows = urls.url_filter(table(spark, sf_dir, "pages").select("page_id", "url"), RULES)
    return rows.select("page_id", "host", "path", "rule", "verdict")


def _levels() -> str:
    """Level by level: the branches of each merged node, what they count for it, and which of them merge."""
    out = ""
    for k in range(urls.LEVELS):
        key = ", ".join(["host", *(f"m{i}" for i in range(k))])
        out += f"""n{k} AS (SELECT {key}, s{k}, sum(l) AS nl, sum(b) AS nb FROM t{k} GROUP BY ALL),
a{k} AS (SELECT {key}, sum(nl) AS al, sum(nb) AS ab, sum(nl / (nl + 1.0::DOUBLE)) AS u{k}, sum(nb / (nl + 1.0::DOUBLE)) AS r{k} FROM n{k} GROUP BY ALL),
p{k} AS (SELECT *, nl::DOUBLE AS l1, (al - nl)::DOUBLE AS l2, (nb + 1.0::DOUBLE) / (nl + 2) AS p1, (ab - nb + 1.0::DOUBLE) / (al - nl + 2) AS p2 FROM n{k} JOIN a{k} USING ({key})),
t{k + 1} AS (SELECT t{k}.*, u{k}, r{k}, CASE WHEN l1 > 0 AND l2 > 0 AND (p1 - p2) * (p1 - p2) / (p1 * (1 - p1) / (l1 + 2) + p2 * (1 - p2) / (l2 + 2)) < {urls.Z2} THEN '*' ELSE s{k} END AS m{k}
        FROM t{k} JOIN p{k} USING ({key}, s{k})),
"""
    return out.rstrip()


def _sql() -> str:
    w, names = urls.PRIOR_WEIGHT, ", ".join(f"m{k}" for k in range(urls.LEVELS))
    above = f"((rd + {w} * share) / (ud + {w}))"
    for k in range(urls.LEVELS):
        above = f"((r{k} + {w} * {above}) / (u{k} + {w}))"
    rule = "CASE "
    for r in sorted(RULES, key=lambda r: (-len(r), r)):
        h, p = urls.split_rule(r)
        rule += f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{r}' "
    label = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in RULES.items()) + " END"
    return f"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{urls.UPPER}', '{urls.LOWER}') AS host,
           coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
r AS (SELECT *, {rule} END AS rule, array_to_string(list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''),
      lambda s: regexp_replace(regexp_replace(s, '^[0-9a-fA-F-]{{16,}}$', '{{id}}'), '[0-9]+', '{{n}}', 'g')), '/') AS lexical FROM u),
l AS (SELECT *, {label} AS label FROM r),
leaves AS (SELECT host, lexical, string_split(lexical, '/') AS segs, count(label) AS l, count(*) FILTER (label = 'block') AS b FROM l GROUP BY ALL),
t0 AS (SELECT host, lexical, l, b, {', '.join(f"coalesce(segs[{k + 1}], '') AS s{k}" for k in range(urls.LEVELS - 1))}, array_to_string(segs[{urls.LEVELS}:], '/') AS s{urls.LEVELS - 1} FROM leaves),
{_levels()}
hosts AS (SELECT host, array_to_string(list_reverse(string_split(host, '.'))[1:2], '.') AS domain, sum(l) AS hl, sum(b) AS hb FROM t{urls.LEVELS} GROUP BY ALL),
domains AS (SELECT domain, sum(hl / (hl + 1.0::DOUBLE)) AS ud, sum(hb / (hl + 1.0::DOUBLE)) AS rd FROM hosts GROUP BY ALL),
share AS (SELECT (sum(b) + 1.0::DOUBLE) / (sum(l) + 2) AS share FROM t{urls.LEVELS}),
leaf AS (SELECT host, {names}, sum(l) AS n_labels, sum(b) AS n_block FROM t{urls.LEVELS} GROUP BY ALL),
bad_leaf AS (SELECT host, lexical FROM t{urls.LEVELS} JOIN leaf USING (host, {names}) JOIN hosts USING (host) JOIN domains USING (domain), share
             WHERE round((n_block + {w} * {above}) / (n_labels + {w}), 9) >= {urls.PURITY})
SELECT page_id, l.host, path, rule, coalesce(label, CASE WHEN b.host IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM l LEFT JOIN bad_leaf b ON l.host = b.host AND l.lexical = b.lexical"""


QUERIES = {"op9_url_filter": op9_url_filter}
ORACLES = {"op9_url_filter": _sql()}
