"""Quality rules whose cutoffs follow the data: fences from mergeable quantile sketches per language and source.

All of it is DataFrame functions. The sketch is a log-linear histogram: a metric's integer value is cut to its six
leading bits (relative error at most 1/32) and counted by (lang, source, metric, value). Sketches merge by adding
counts, so the same table gives the sketches of a language and of all data.

A group's quartiles are shrunk towards its language's, and these towards all data's, by weights that fall smoothly as
the group grows. A group's fence also lies at most ``OUTER`` times as far out as its language's, so a source of mostly
spam cannot set itself free, however large it is, unless it is a quarter of its language.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .session import staged

#: Characters that count as symbols (a fixed value).
SYMBOLS = "#*$%&|<>"
#: Metric: (least spread, whether a low value is rejected too). A fence lies SPREADS spreads beyond a quartile.
METRICS = {"symbols": (20, False), "dup_lines": (100, False), "repeats": (60, False), "word_length": (100, True), "bangs": (60, False)}
SPREADS = 3
#: How many documents a parent's quartiles count for, and how much farther out than its language's a group's fence may lie.
WEIGHT, OUTER = 20, 2
#: Most rows of fences that are broadcast (about 100 bytes each); more are joined by keys salted this many times.
BROADCAST_GROUPS, SALTS = 200_000, 16


def features(df: DataFrame, text: str = "text") -> DataFrame:
    """Append n_words, word_chars, n_symbols, n_bangs, n_lines, n_dup_lines and n_repeat_words (long) to ``df``.

    Words are runs other than U+0020 and U+0009-U+000D. A null or empty text counts as no words and no lines.
    Existing columns with these names are replaced; working columns start with ``_q_``. Repeats are found in the
    row's own arrays by 64-bit window hashes, so nothing is shuffled, whatever a text's length.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    kept = [c for c in df.columns if c not in FEATURES]
    df = df.select(*kept, F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), "").alias("_q_w"), F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_q_l"), t.alias("_q_t"))
    w = F.col("_q_w")
    df = df.withColumn(
        "_q_h",
        F.when(
            F.size(w) >= 5,
            F.transform(F.slice(w, 1, F.greatest(F.size(w) - 4, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2), F.get(w, i + 3), F.get(w, i + 4))),
        ),
    )
    h = F.col("_q_h")
    df = df.withColumn("_q_s", F.when(F.size(F.array_distinct(h)) < F.size(h), F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    s = F.col("_q_s")
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    df = df.withColumn("_q_p", F.array_sort(F.transform(F.filter(s, lambda x, i: F.when(i > 0, same(x, F.get(s, i - 1))).otherwise(False) | same(x, F.get(s, i + 1))), lambda x: x["i"])))
    p = F.col("_q_p")
    df = df.withColumn("_q_d", F.transform(p, lambda x, i: F.least(F.lit(5), F.coalesce(F.get(p, i + 1) - x, F.lit(5)))))
    bare = reduce(lambda c, x: F.replace(c, F.lit(x), F.lit("")), SYMBOLS, F.col("_q_t"))
    long = lambda c: c.cast("long")
    return df.select(
        *kept,
        long(F.size(w)).alias("n_words"),
        long(F.length(F.array_join(w, ""))).alias("word_chars"),
        long(F.length("_q_t") - F.length(bare)).alias("n_symbols"),
        long(F.length("_q_t") - F.length(F.replace("_q_t", F.lit("!"), F.lit("")))).alias("n_bangs"),
        long(F.size("_q_l")).alias("n_lines"),
        long(F.size("_q_l") - F.size(F.array_distinct("_q_l"))).alias("n_dup_lines"),
        long(F.coalesce(F.aggregate("_q_d", F.lit(0), lambda a, x: a + x), F.lit(0))).alias("n_repeat_words"),
    )


FEATURES = ("n_words", "word_chars", "n_symbols", "n_bangs", "n_lines", "n_dup_lines", "n_repeat_words")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def metric_values() -> dict[str, Column]:
    """Per-mille metrics as integers; a text without words has nulls, which no sketch counts."""
    some = lambda n, d: F.when(d > 0, F.floor(n * 1000 / d).cast("long"))
    c = F.col
    return {
        "symbols": some(c("n_symbols"), c("word_chars")),
        "dup_lines": some(c("n_dup_lines"), c("n_lines")),
        "repeats": some(c("n_repeat_words"), c("n_words")),
        "word_length": F.when(c("n_words") > 0, F.floor(c("word_chars") * 100 / c("n_words")).cast("long")),
        "bangs": some(c("n_bangs"), c("n_words")),
    }


def sketches(features: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, metric, value, n: the histogram sketches; null keys count as ''."""
    values = F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("v")) for m, v in metric_values().items()])
    rows = features.select(F.coalesce(lang, F.lit("")).alias("lang"), F.coalesce(source, F.lit("")).alias("source"), F.explode(values).alias("x"))
    v = F.col("x.v")
    cut = F.greatest(F.lit(0), F.length(F.bin(v)) - 6)
    value = F.expr("shiftleft(shiftright(x.v, s), s)")
    return rows.where(v.isNotNull()).withColumn("s", cut).groupBy("lang", "source", F.col("x.metric").alias("metric"), value.alias("value")).agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    return sketch.groupBy(*keys, "metric", "value").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, metric, docs, q25, q75 of each sketch: the least value at or below which so many counts lie."""
    group = [*keys, "metric"]
    upto = W.partitionBy(*group).orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    rows = sketch.withColumn("upto", F.sum("n").over(upto)).withColumn("docs", F.sum("n").over(W.partitionBy(*group)))
    least = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("docs"), F.col("value")))
    return rows.groupBy(*group).agg(F.max("docs").alias("docs"), least(1).alias("q25"), least(3).alias("q75"))


def fences(sketch: DataFrame, weight: int = WEIGHT) -> DataFrame:
    """One row for each (lang, source): lo_<metric> and hi_<metric>, from the shrunk quartiles of the group and its parents."""
    own = quartiles(sketch, ["lang", "source"])
    by_lang = quartiles(merged(sketch, ["lang"]), ["lang"]).select("lang", "metric", *[F.col(c).alias(f"{c}_l") for c in ("docs", "q25", "q75")])
    all_data = quartiles(merged(sketch, []), []).select("metric", *[F.col(c).alias(f"{c}_a") for c in ("q25", "q75")])
    rows = own.join(by_lang, ["lang", "metric"]).join(all_data, "metric")
    c = F.col
    least = reduce(lambda x, m: x.when(c("metric") == m, METRICS[m][0]), METRICS, F.when(F.lit(False), 0))
    shrunk = lambda n, q, parent: (n * q + weight * parent) / (n + weight)
    rows = rows.select("lang", "source", "metric", "docs", "q25", "q75", "docs_l", *[shrunk(c("docs_l"), c(f"{q}_l"), c(f"{q}_a")).alias(f"{q}_l") for q in ("q25", "q75")])
    rows = rows.withColumns({q: shrunk(c("docs"), c(q), c(f"{q}_l")) for q in ("q25", "q75")})
    rows = rows.withColumns({f"d{k}": SPREADS * F.greatest(c(f"q75{k}") - c(f"q25{k}"), least) for k in ("_l", "")})
    hi = F.round(F.least(c("q75") + c("d"), c("q75_l") + OUTER * c("d_l")), 6)
    lo = F.round(F.greatest(c("q25") - c("d"), c("q25_l") - OUTER * c("d_l")), 6)
    rows = rows.select("lang", "source", "metric", hi.alias("hi"), lo.alias("lo"))
    only = lambda m, v: F.max(F.when(c("metric") == m, c(v))).alias(f"{v}_{m}")
    return rows.groupBy("lang", "source").agg(*[only(m, "lo") for m, (_, both) in METRICS.items() if both], *[only(m, "hi") for m in METRICS])


def judged(features: DataFrame, lang: str = "lang", source: str = "source", weight: int = WEIGHT) -> DataFrame:
    """Append base_failed and kept to a table with features(); it is read twice, so pass a staged one.

    kept is false where the base rules fail, else true where every metric lies within the fences of the row's
    language and source. Rows are never dropped; equal rows get equal verdicts; null keys share the key ''.
    The fences have one row for each group, so the join never multiplies rows. They are broadcast up to
    BROADCAST_GROUPS rows; more are joined by (lang, source, salt), so that a hot source is dealt to several tasks.
    """
    limits = staged(fences(sketches(features, lang, source), weight), "fences").withColumnsRenamed({"lang": "_q_lang", "source": "_q_source"})
    same = (F.coalesce(lang, F.lit("")) == F.col("_q_lang")) & (F.coalesce(source, F.lit("")) == F.col("_q_source"))
    if limits.count() <= BROADCAST_GROUPS:
        rows = features.join(F.broadcast(limits), same, "left")
    else:
        limits = limits.withColumn("_q_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = features.withColumn("_q_own", F.pmod(F.hash(*FEATURES), F.lit(SALTS))).join(limits, same & (F.col("_q_own") == F.col("_q_salt")), "left")
    values = metric_values()
    inside = [values[m] <= F.col(f"hi_{m}") for m in METRICS] + [values[m] >= F.col(f"lo_{m}") for m, (_, both) in METRICS.items() if both]
    ok = reduce(lambda a, b: a & b, inside)
    kept = ~base_failed() & F.coalesce(ok, F.lit(True))
    return rows.select(*[c for c in features.columns if c not in ("base_failed", "kept")], base_failed().alias("base_failed"), kept.alias("kept"))


def quality_rules(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Features and verdicts of every row of ``df``, with the ``carry`` columns; the text itself is not carried on."""
    rows = staged(features(df.select(*dict.fromkeys([*carry, lang, source, text])), text).drop(text), "quality-features")
    return judged(rows, lang, source)
