"""URL filters: explicit rules first, then verdicts of path templates learned per host. DataFrame functions only.

A URL's path is cut into segments, and digits and long hexadecimal ids in them become wildcards. The distinct
(host, path) templates form a tree per host, built level by level: below each merged node, the branches whose labelled
share of blocked pages does not differ from that of their siblings (two-proportion z test; both sides need labels) are
merged into one '*' branch, and the next level is keyed by the merged path.

A node's purity is the mean of its branches' labelled shares, shrunk towards its parent's: a branch counts l / (l + 1)
for l labels, so at most once, however large it is, against ``PRIOR_WEIGHT`` for the parent. Above a host stand its
registered domain (the last two labels, whose hosts are its branches) and all data. A template's own labels are shrunk
towards its node. So a template without labels has the purity of its nearest labelled ancestors; one bad branch of one
host does not reject its siblings, but a domain with nothing but bad labels on several hosts is rejected. The labels
are the explicit rules' own verdicts, or any label column.

Every step groups by (host, template) with partial counts; a host with a third of all pages costs a few rows for
each task. Rows of pages are joined once, to the rejected templates only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import Scratch, staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Levels of a host's tree; the last holds all further segments as one.
LEVELS = 4
#: Squared z below which two shares count as alike (95 %).
Z2 = 3.84
#: What a parent's purity counts against branches or labels, and the least purity of a rejected template.
PRIOR_WEIGHT, PURITY = 4.0, 0.7


def host(url: str) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; '' for a null or other URL."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: str) -> Column:
    """After the host up to '?', '#' or the end; '' for a null or other URL."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 2), F.lit(""))


def split_rule(rule: str) -> tuple[str, str]:
    """'example.net/en/' -> ('example.net', '/en/')."""
    at = rule.index("/")
    return rule[:at], rule[at:]


def matched_rule(rules: dict[str, str]) -> Column:
    """Of ``rules`` ('host/path' -> 'block' or 'allow'), the longest that fits columns host and path, else null.

    Rules are looked up by each suffix of the host, so the cost grows with the host's labels, not the rules.
    """
    if not rules:
        return F.lit(None).cast("string")
    by_host: dict[str, list[str]] = {}
    for r in sorted(rules, key=lambda r: (-len(r), r)):
        by_host.setdefault(split_rule(r)[0], []).append(r)
    table = F.create_map(*[x for h, rs in by_host.items() for x in (F.lit(h), F.array(*map(F.lit, rs)))])
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = F.flatten(F.filter(F.transform(suffixes, lambda s: F.element_at(table, s)), lambda x: x.isNotNull()))
    fits = F.filter(found, lambda r: F.startswith(F.col("path"), F.regexp_extract(r, r"^[^/]*(.*)$", 1)))
    longest = F.array_sort(F.transform(fits, lambda r: F.struct((-F.length(r)).alias("n"), r.alias("r"))))
    return F.get(longest, 0)["r"]


def segments() -> Column:
    """The segments of column path with digits as {n} and long hexadecimal ids as {id}."""
    return F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), lambda s: F.regexp_replace(F.regexp_replace(s, r"^[0-9a-fA-F-]{16,}$", "{id}"), "[0-9]+", "{n}"))


def template_tree(pages: DataFrame, scratch: Scratch, weight: float = PRIOR_WEIGHT) -> DataFrame:
    """host, lexical, template, n_labels, n_block, purity: each lexical path with its template after merging branches.

    ``pages`` has host, lexical ('/'-joined segments), both not null, and label ('block', 'allow' or null).
    """
    c = F.col
    labels = [F.count("label").alias("l"), F.count(F.when(c("label") == "block", 1)).alias("b")]
    segs = F.split("lexical", "/")
    own = [F.coalesce(F.get(segs, F.lit(k)), F.lit("")).alias(f"s{k}") for k in range(LEVELS - 1)]
    rest = F.array_join(F.slice(segs, LEVELS, F.greatest(F.size(segs) - LEVELS + 1, F.lit(0))), "/").alias(f"s{LEVELS - 1}")
    rows = scratch.staged(pages.groupBy("host", "lexical").agg(*labels).select("*", *own, rest), "url-leaves")
    for k in range(LEVELS):
        key, child = ["host", *(f"m{i}" for i in range(k))], f"s{k}"
        nodes = rows.groupBy(*key, child).agg(F.sum("l").alias("nl"), F.sum("b").alias("nb"))
        units = [F.sum(c("nl") / (c("nl") + 1.0)).alias(f"u{k}"), F.sum(c("nb") / (c("nl") + 1.0)).alias(f"r{k}")]
        above = nodes.groupBy(*key).agg(F.sum("nl").alias("al"), F.sum("nb").alias("ab"), *units)
        l1, l2 = c("nl"), c("al") - c("nl")
        p1, p2 = (c("nb") + 1.0) / (l1 + 2), (c("ab") - c("nb") + 1.0) / (l2 + 2)
        z2 = (p1 - p2) * (p1 - p2) / (p1 * (1 - p1) / (l1 + 2) + p2 * (1 - p2) / (l2 + 2))
        merged = F.when((l1 > 0) & (l2 > 0) & (z2 < Z2), "*").otherwise(c(child)).alias(f"m{k}")
        nodes = nodes.join(above, key).select(*key, child, merged, f"u{k}", f"r{k}")
        rows = scratch.staged(rows.join(nodes, [*key, child]), f"url-level-{k}")
    names = [f"m{k}" for k in range(LEVELS)]
    domain = F.array_join(F.slice(F.reverse(F.split("host", r"\.")), 1, 2), ".").alias("domain")
    hosts = rows.groupBy("host").agg(F.sum("l").alias("hl"), F.sum("b").alias("hb"))
    domains = hosts.groupBy(domain).agg(F.sum(c("hl") / (c("hl") + 1.0)).alias("ud"), F.sum(c("hb") / (c("hl") + 1.0)).alias("rd"))
    share = rows.agg(((F.sum("b") + 1.0) / (F.sum("l") + 2)).alias("share")).scalar()
    of = rows.groupBy("host", *names).agg(F.sum("l").alias("n_labels"), F.sum("b").alias("n_block"))
    rows = rows.join(of, ["host", *names]).withColumn("domain", domain).join(domains, "domain")
    p = (c("rd") + weight * F.coalesce(share, F.lit(0.5))) / (c("ud") + weight)
    for k in range(LEVELS):
        p = (c(f"r{k}") + weight * p) / (c(f"u{k}") + weight)
    p = F.round((c("n_block") + weight * p) / (c("n_labels") + weight), 9)
    return rows.select("host", "lexical", F.array_join(F.filter(F.array(*names), lambda x: x != ""), "/").alias("template"), "n_labels", "n_block", p.alias("purity"))


def url_filter(df: DataFrame, rules: dict[str, str], url: str = "url", purity: float = PURITY) -> DataFrame:
    """Append host, path, rule, verdict ('block' or 'allow') to ``df``; existing columns so named are replaced.

    The longest fitting rule decides; else a rejected template blocks and any other URL is allowed. A null URL or
    one without '://' has an empty host and path, no rule and the verdict of the empty template. Repeated rows each
    get their verdict; no row is lost. Without rules, or without pages that they fit, everything is allowed.
    """
    new = ("host", "path", "rule", "verdict")
    rows = df.select(*[c for c in df.columns if c not in new], host(url).alias("host"), path(url).alias("path")).withColumn("rule", matched_rule(rules))
    label = F.element_at(F.create_map(*[F.lit(x) for kv in rules.items() for x in kv]), F.col("rule")) if rules else F.lit(None).cast("string")
    rows = rows.withColumns({"_u_label": F.when(F.col("rule").isNotNull(), label), "_u_lexical": F.array_join(segments(), "/")})
    with Scratch(df.sparkSession) as scratch:
        tree = template_tree(rows.select("host", F.col("_u_lexical").alias("lexical"), F.col("_u_label").alias("label")), scratch)
        bad = staged(tree.where(F.col("purity") >= purity).select(F.col("host").alias("_u_host"), F.col("lexical").alias("_u_bad")), "url-rejected")
    out = rows.join(bad, (F.col("host") == F.col("_u_host")) & (F.col("_u_lexical") == F.col("_u_bad")), "left")
    verdict = F.coalesce("_u_label", F.when(F.col("_u_bad").isNotNull(), "block").otherwise("allow"))
    return out.withColumn("verdict", verdict).drop("_u_label", "_u_lexical", "_u_host", "_u_bad")
