"""Merkle manifest of a dataset: nodes are labelled with the interval of leaf ranks that they cover.

Each group (a source) has its own tree over its leaves in order; the groups' roots are the leaves of one more tree.
A node covers the ranks [lo, hi) of its group. Its parent's interval holds it, and its siblings cover the rest of that
interval. Intervals of one level start at multiples of a power of the fan-out, so ancestors are joined level by level in
buckets of ranks: all rows of a bucket have one ancestor, and none has more than a fan-out of children.

Ranks come from a range sort over (group, order) in many tasks, the rows of each piece counted, and sums over the pieces
before it; a group of any size is cut into as many pieces as it fills.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import staged

FANOUT = 16
_STEP = "array<struct<left: string, right: string>>"


def encoded(column: str) -> Column:
    """'-' for null, else the value's UTF-8 byte count, ':' and the value."""
    s = F.col(column).cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts in a row."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def group_key(column: str) -> Column:
    """A key that is never null and sorts as the column does in bytes, null first."""
    return F.when(F.col(column).isNull(), "").otherwise(F.concat(F.lit("s"), F.col(column).cast("string")))


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` (with g) and lo, hi, n: the rank of each in its group by ``order`` (nulls first), that plus one, and the group's rows.

    Rows that agree in ``order`` are ranked in any one order. ``rows`` must read the same each time.
    """
    keys = ["g", *order]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()  # a task's number, and the row's place in it
    cut = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("at", at).withColumn("piece", F.shiftright("at", 33))
    cut = staged(cut, f"{name}-sorted")
    before = Window.partitionBy("g").orderBy("piece")
    pieces = cut.groupBy("g", "piece").agg(F.min("at").alias("first"), F.count("*").alias("size"))
    pieces = pieces.withColumn("n", F.sum("size").over(Window.partitionBy("g"))).withColumn("before", F.sum("size").over(before) - F.col("size"))
    lo = F.col("at") - F.col("first") + F.col("before")
    return cut.join(pieces.drop("size"), ["g", "piece"]).withColumn("lo", lo).withColumn("hi", F.col("lo") + 1).drop("at", "piece", "first", "before")


def _bucket(level: int) -> Column:
    """The interval of ``level`` that a rank lies in."""
    return F.expr(f"lo div {FANOUT**level}L")


def families(leaves: DataFrame, carry: list[str], name: str) -> list[DataFrame]:
    """For each level from 1 up: g, n, lo, hi, digest and children (lo, hi, digest; on level 1 also ``carry``) of its nodes.

    ``leaves`` has g, n, lo, hi, digest. A group has nodes up to the one that covers it whole; the node over a lone leaf
    is that leaf.
    """
    out, below, extra = [], leaves, carry
    most = None
    while most is None or FANOUT ** len(out) < most:
        level = len(out) + 1
        made = below.groupBy("g", "n", _bucket(level).alias("bucket")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.array_sort(F.collect_list(F.struct("lo", "hi", "digest", *extra))).alias("children"))
        joined = F.array_join(F.transform("children", lambda c: c["digest"]), "")
        made = staged(made.withColumn("digest", F.when(F.col("n") == 1, joined).otherwise(digest(joined))).drop("bucket"), f"{name}-level-{level}")
        out.append(made)
        if most is None:
            most = made.agg(F.max("n")).head()[0] or 0
        below, extra = made.where(F.col("n") > FANOUT**level).select("g", "n", "lo", "hi", "digest"), []
    return out


def _whole() -> Column:
    return (F.col("lo") == 0) & (F.col("hi") == F.col("n"))


def tops(levels: list[DataFrame]) -> DataFrame:
    """g and digest of each group's root."""
    found = [f.where(_whole()).select("g", "digest") for f in levels]
    return functools.reduce(DataFrame.unionByName, found)


def _siblings(children: Column, lo: Column, hi: Column) -> Column:
    """What is left of the parent's interval before and after [lo, hi): digests of the children there, left to right."""
    joined = lambda keep: F.array_join(F.transform(F.filter(children, keep), lambda c: c["digest"]), "")
    return F.struct(joined(lambda c: c["hi"] <= lo).alias("left"), joined(lambda c: c["lo"] >= hi).alias("right"))


def with_paths(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """The families of level 1 with ``path``, the siblings of their node and of its ancestors up to the last tree's root.

    ``above`` has g, path (that of the group's root) and columns that all of a group's rows get.
    """
    up = None
    extra = [c for c in above.columns if c not in ("g", "path")]
    for level in range(len(levels), 0, -1):
        own = levels[level - 1]
        found = own.where(_whole()).join(above, "g")
        if up is not None:
            a = up.select("g", _bucket(level + 1).alias("bucket"), F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"), F.col("children").alias("a_children"), F.col("path").alias("a_path"), *extra)
            inside = (F.col("a_lo") <= F.col("lo")) & (F.col("hi") <= F.col("a_hi"))
            d = own.where(~_whole()).withColumn("bucket", _bucket(level + 1)).join(a, ["g", "bucket"]).where(inside)
            path = F.concat(F.array(_siblings(F.col("a_children"), F.col("lo"), F.col("hi"))), F.col("a_path"))
            found = found.unionByName(d.withColumn("path", path).select(*found.columns))
        up = found
    return up


def manifest(leaves: DataFrame, order: list[str], carry: list[str]) -> DataFrame:
    """Leaves with their place in the dataset: ``carry``, leaf, subroot, root and path.

    ``leaves`` (staged) has g, digest, ``order`` and ``carry``. path lists, from the leaf up, the siblings' digests on
    each level as one left and one right string; a lone node's are empty strings, a lone leaf has no step in its own tree.
    """
    first = families(ranked(leaves, order, "leaves"), carry, "leaves")
    groups = staged(tops(first).select(F.lit("").alias("g"), F.col("g").alias("of"), "digest"), "subroots")
    second = families(ranked(groups, ["of"], "groups"), ["of"], "groups")
    root = tops(second).select("g", F.col("digest").alias("root"), F.array().cast(_STEP).alias("path"))
    above = _leaves(with_paths(second, root), ["of", "root"]).select(F.col("of").alias("g"), F.col("digest").alias("subroot"), "root", "path")
    return _leaves(with_paths(first, above), [*carry, "subroot", "root"]).select(*carry, F.col("digest").alias("leaf"), "subroot", "root", "path")


def _leaves(runs: DataFrame, columns: list[str]) -> DataFrame:
    rows = runs.select("*", F.explode("children").alias("c"))
    own = _siblings(F.col("children"), F.col("c.lo"), F.col("c.hi"))
    path = F.when(F.col("n") == 1, F.col("path")).otherwise(F.concat(F.array(own), F.col("path")))
    inner = {f.name for f in runs.schema["children"].dataType.elementType.fields}
    return rows.select(F.col("c.digest").alias("digest"), path.alias("path"), *[F.col(f"c.{x}").alias(x) if x in inner else F.col(x) for x in columns])


def proof_digest(path: str = "path") -> Column:
    """The digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)


def folded(leaf: Column, path: str = "path") -> Column:
    """The root that follows from a leaf's digest and its siblings."""
    return F.aggregate(path, leaf, lambda d, s: F.sha2(F.concat(s["left"], d, s["right"]).cast("binary"), 256))


def document_manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """The manifest of documents: doc_id, leaf, claimed, subroot, root and path of each row.

    A leaf is the digest of doc_id, source, lang, n_chars and text; trees are by source (null is one), in order of
    doc_id (nulls first; equal ones by digest; rows that agree in both are alike and take places side by side). claimed
    is the digest that the row would have with ``tampered`` in place of its text (its leaf, if that is null or not
    given). Other columns are not read; an empty table gives no rows.
    """
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    leaf = digest(*map(encoded, columns))
    rows = docs.select(*columns) if tampered is None else docs.select(*columns, tampered.alias("_other"))
    other = F.lit(None).cast("string")
    if tampered is not None:
        changed = digest(*map(encoded, columns[:-1]), encoded("_other"))
        other = F.when(F.col("_other").isNotNull() & (F.col("_other") != F.col("text")), changed)
    # a row's place in its file parts rows that are alike, so that a great many of them are cut into pieces too
    rows = rows.select(group_key("source").alias("g"), "doc_id", leaf.alias("digest"), other.alias("other"), F.monotonically_increasing_id().alias("seq"))
    found = manifest(staged(rows, "merkle-leaves"), ["doc_id", "digest", "seq"], ["doc_id", "other"])
    return found.select("doc_id", "leaf", F.coalesce("other", "leaf").alias("claimed"), "subroot", "root", "path")
