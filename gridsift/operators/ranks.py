"""Numbers of rows in an order, and ranges of groups, without a window that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import staged


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``, its rows' places in ``order`` from 1: a range sort, one count a task, and sums of those before."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = staged(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    before, offsets = 0, []
    for r in at.groupBy(F.shiftright("_at", 33).alias("task")).agg(F.count("*").alias("n")).orderBy("task").collect():  # one row a task
        offsets.append((r.task, before - (r.task << 33) + 1))
        before += r.n
    tasks = df.sparkSession.createDataFrame(offsets, "_task long, _offset long")
    return at.withColumn("_task", F.shiftright("_at", 33)).join(F.broadcast(tasks), "_task").withColumn(name, F.col("_at") + F.col("_offset")).drop("_at", "_task", "_offset")


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """``left`` with the other columns of ``right``, one row a group; null keys are a group, and without keys there is one row."""
    if not keys:
        return left.join(F.broadcast(right), F.lit(True), how)
    own = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return left.join(own, same, how).drop(*[f"_k_{k}" for k in keys])


def with_range(df: DataFrame, keys: list[str], column: str, lo: str = "_lo", hi: str = "_hi") -> DataFrame:
    """``df`` with the least and greatest ``column`` of each row's group: aggregated first, then joined back; null keys are a group."""
    return joined(df, df.groupBy(*keys).agg(F.min(column).alias(lo), F.max(column).alias(hi)), keys, "inner")


def with_previous(df: DataFrame, keys: list[str], order: list[Column], columns: list[str], prefix: str = "_prev_") -> DataFrame:
    """``df`` with each row's predecessor in its group by ``order``: ``columns`` as prefix + name, null for the first.

    A range sort cuts groups into tasks; inside a task a window looks back, and a task's first row of a group takes the
    last one of the task before that has the group. No window holds a group, whatever its size.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*map(F.col, keys), *order]
    at = staged(df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()).withColumn("_task", F.shiftright("_at", 33)), "in-order")
    row = F.struct(*columns)
    last = at.groupBy(*keys, "_task").agg(F.max_by(row, "_at").alias("_last"))
    before = last.withColumn("_before", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_task")))  # at most one row a task
    before = before.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_task").alias("_t"), "_before")
    same = F.col("_task") == F.col("_t")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    found = at.withColumn("_own", F.lag(row).over(Window.partitionBy("_task", *keys).orderBy("_at"))).join(before, same)
    there = F.coalesce("_own", "_before")
    return found.select(*df.columns, *[there[c].alias(f"{prefix}{c}") for c in columns])


def quantiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """keys and, by name, the exact quantile (linear between ranks) of a column in each group; nulls do not count, a group of nulls has null.

    Values go through a range sort, tasks count their share of each group, and only the two rows around each quantile are
    looked up: nothing buffers a group, whatever its size.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = F.array(*[F.struct(F.lit(name).alias("_name"), F.lit(float(f)).alias("_f"), c.cast("double").alias("_x")) for name, (c, f) in wanted.items()])
    by = [*keys, "_name"]
    rows = df.select(*keys, F.explode(named).alias("_v")).select(*keys, "_v.*").where("_x IS NOT NULL")
    rows = rows.repartitionByRange(parts, *by, "_x").sortWithinPartitions(*by, "_x").withColumn("_at", F.monotonically_increasing_id())
    rows = staged(rows.withColumn("_task", F.shiftright("_at", 33)), "values-in-order")
    pieces = rows.groupBy(*by, "_f", "_task").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_task")) - F.col("_n")  # at most one row a task
    pieces = pieces.withColumn("_before", before).withColumn("_place", (F.sum("_n").over(Window.partitionBy(*by)) - 1) * F.col("_f"))
    lo, hi = F.floor("_place"), F.ceil("_place")
    ends = F.when(lo == hi, F.array(F.struct(lo.alias("r"), F.lit(1.0).alias("w")))).otherwise(F.array(F.struct(lo.alias("r"), (hi - F.col("_place")).alias("w")), F.struct(hi.alias("r"), (F.col("_place") - lo).alias("w"))))
    ends = pieces.select("_first", "_before", "_n", F.explode(ends).alias("_e")).where((F.col("_e.r") >= F.col("_before")) & (F.col("_e.r") < F.col("_before") + F.col("_n")))
    ends = ends.select((F.col("_first") + F.col("_e.r") - F.col("_before")).alias("_want"), F.col("_e.w").alias("_w"))  # at most two rows a group and name
    found = rows.join(ends, F.col("_at") == F.col("_want")).groupBy(*keys).agg(*[F.sum(F.when(F.col("_name") == name, F.col("_x") * F.col("_w"))).alias(name) for name in wanted])
    return joined(df.groupBy(*keys).agg(F.count("*").alias("_rows")), found, keys).drop("_rows")
