"""Connected components of links by alternating large-star and small-star steps, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import drop_stage, stage_path, staged


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the least of it and its neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of them; edges have a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    return edges.join(least, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a < b").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every edge leads from a component's least node to one of its others: no node is a target twice, or both ends."""
    ends = edges.select("b", F.lit(0).alias("start")).unionByName(edges.select(F.col("a").alias("b"), F.lit(1).alias("start")).distinct())
    return not ends.groupBy("b").agg(F.count("*").alias("n")).where("n > 1").head(1)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the least node that links reach) of every node of ``links``, a table of node pairs.

    Loops, repeats and both directions of a link are fine; rows with a null are skipped. The number of rounds grows
    with the logarithm of a component's width. Only whether the edges are stars yet comes to the driver, and a node
    with very many links is never gathered: steps are joins on partial minima, whose hot keys Spark splits.
    """
    pair = links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    spark = links.sparkSession
    path = stage_path(spark, "edges")
    edges = staged(pair.where("a < b").distinct(), "edges", path)
    while not _stars(edges):
        old, path = path, stage_path(spark, "edges")
        edges = staged(_small_star(_large_star(edges)), "edges", path)
        drop_stage(spark, old)
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component"))).distinct()
