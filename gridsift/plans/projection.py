"""The ``embeddings`` table as a gallery of 10 x 10 grids, in Spark and as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import EPSILON, vector_mean

GRID = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, image_id, row, col, embedding, label, labels, split."""
    image = F.floor(F.col("vec_id") / 100)
    part = F.when(image % 5 < 3, "train").when(image % 5 == 3, "val").otherwise("test")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", image.cast("string").alias("image_id"), F.floor(F.col("vec_id") % 100 / 10).cast("int").alias("row"), (F.col("vec_id") % 10).cast("int").alias("col"),
        F.col("embedding").cast("array<double>").alias("embedding"), "label", F.array(F.concat(F.lit("class_"), F.col("label").cast("string"))).alias("labels"), part.alias("split"),
    )


def cls(p: DataFrame) -> DataFrame:
    return vector_mean(p, ["image_id", "split"], normalise=False)


P = f"""p AS (SELECT vec_id, CAST(vec_id // 100 AS VARCHAR) AS image_id, CAST(vec_id % 100 // 10 AS INT) AS "row", CAST(vec_id % 10 AS INT) AS col,
      CAST(embedding AS DOUBLE[]) AS e, label, 'class_' || label AS class,
      CASE WHEN vec_id // 100 % 5 < 3 THEN 'train' WHEN vec_id // 100 % 5 = 3 THEN 'val' ELSE 'test' END AS split FROM embeddings)"""


def cos_sql(a: str, b: str) -> str:
    return f"(list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})) + {EPSILON}))"


def mean_sql(source: str, keys: str, normalise: bool = True, vector: str = "e") -> str:
    """keys and the mean vector as e."""
    raw = f"SELECT {keys}, list(m ORDER BY i) AS e FROM (SELECT {keys}, i, avg(x) AS m FROM (SELECT {keys}, unnest({vector}) AS x, generate_subscripts({vector}, 1) AS i FROM {source}) GROUP BY ALL) GROUP BY {keys}"
    return f"SELECT {keys}, list_transform(e, lambda x: x / greatest(sqrt(list_dot_product(e, e)), 1e-12)) AS e FROM ({raw})" if normalise else raw


def round_sql(v: str) -> str:
    return f"list_transform({v}, lambda x: round(x, 6) + 0.0)"


def greedy_sql(n: str, source: str = "(SELECT vec_id AS id, u FROM u WHERE split = 'train')") -> str:
    """Greedy k-centre of n rows: after each step, the one chosen (new) and each row's least distance so far (-1 for chosen ones)."""
    d = "round(1 - list_dot_product(x.u, c.u), 12)"
    return f"""x AS MATERIALIZED (SELECT * FROM {source}), g AS (SELECT 1 AS step, x.id, c.id AS new, CASE WHEN x.id = c.id THEN -1 ELSE {d} END AS far FROM x, (SELECT * FROM x ORDER BY id LIMIT 1) c
    UNION ALL SELECT step + 1, s.id, s.next, CASE WHEN s.id = s.next THEN -1 ELSE least(s.far, {d}) END FROM (SELECT *, first_value(id) OVER (ORDER BY far DESC, id) AS next FROM g) s JOIN x ON x.id = s.id JOIN x c ON c.id = s.next WHERE step < {n})"""


#: Scores of all patches against the vector of patch 0, and the truth cells of class 3.
S = f"""s AS (SELECT image_id, "row", col, split, label, round({cos_sql("p.e", "z.e")}, 6) AS score, label = 3 AS truth FROM p, (SELECT e FROM p WHERE vec_id = 0) z)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.retrieval import with_similarity

    p = patches(spark, sf_dir)
    zero = p.where("vec_id = 0").select("embedding").head()
    return with_similarity(p, zero.embedding).select("image_id", "row", "col", "split", "label", F.round("similarity", 6).alias("score"), (F.col("label") == 3).alias("truth"))
