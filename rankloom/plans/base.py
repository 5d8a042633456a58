"""Registry of queries with their SQL twins, and the tables and SQL parts that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

SEEDS = (7, 42, 67, 89, 90)
ALPHAS = (0, 3, 5, 10)  # tenths
KS = (2, 5, 10)
LAYERS, LAYER_WIDTH, WIDTH = 4, 16, 64


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{d}/{name}.parquet")


def r6(c: Column | str) -> Column:
    """Rounded to 6 decimals, and 0 for -0."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


def values(spark: SparkSession, items, schema: str) -> DataFrame:
    return spark.createDataFrame([x if isinstance(x, tuple) else (x,) for x in items], schema)


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """(vec_id, vec, label, fact): the lower half of the labels is the factual side."""
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"), "label", (F.col("label") < 5).alias("fact"))


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """documents with their labels; side: supporting, misleading or unrelated."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    side = F.when(F.col("quality").isNull(), "unrelated").when((F.col("quality") == 1) & (F.col("toxic") == 0), "supporting").otherwise("misleading")
    return docs.join(labels, "doc_id", "left").withColumn("side", side)


V = "v as (select vec_id, embedding::double[] as vec, label, label < 5 as fact from embeddings)"
E = "e as (select vec_id, label, fact, unnest(vec) as x, generate_subscripts(vec, 1) - 1 as i from v)"
DIR = "d as (select i, avg(x) filter (where fact) - avg(x) filter (where not fact) as v from e group by i), dir as (select list(v order by i) as dir from d)"
LAB = """lab as (select doc_id, text, lang, source, n_chars, quality, toxic,
  case when quality is null then 'unrelated' when quality = 1 and toxic = 0 then 'supporting' else 'misleading' end as side from documents left join labels using (doc_id))"""
