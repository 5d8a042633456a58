"""Scores, z-scores, ranks and top-k.

Ranks order by the score rounded to 9 decimals, largest first, then by the smaller id, so ties are the same in every run. Statistics
and target ranks are aggregates with a map-side part, never a window over a whole corpus; top-k is a limited row_number, which Spark
cuts down before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordered as ordered_rows

#: Queries are compared in blocks of so many numbers, so what is broadcast has a bound.
BROADCAST_NUMBERS = 4_000_000


def zscore(df: DataFrame, value: str, by: list[str], out: str, policy: str = "null") -> DataFrame:
    """df with the z-score of value within by, population deviation.

    policy for a flat group: null gives null, eps adds 1e-8 to the deviation, zero gives 0.
    """
    stats = df.groupBy(*by).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    joined = df.join(stats, [*by]) if by else df.crossJoin(F.broadcast(stats))  # without keys one row
    centred = F.col(value) - F.col("__m")
    z = {"null": F.try_divide(centred, F.when(F.col("__s") > 1e-12, F.col("__s"))), "eps": centred / (F.col("__s") + 1e-8), "zero": F.when(F.col("__s") < 1e-12, 0.0).otherwise(F.try_divide(centred, F.col("__s")))}[policy]
    return joined.withColumn(out, z).drop("__m", "__s")


def fuse(similarity: Column, projection: Column, alpha: Column) -> Column:
    return (1 - alpha) * similarity + alpha * projection


def ordered(score: str, ident: str) -> list[Column]:
    return [F.desc_nulls_last(F.round(F.nanvl(F.col(score), F.lit(None).cast("double")), 9)), F.col(ident).asc()]


def position(by: list[str], score: str, ident: str) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*ordered(score, ident)))


def competition(by: list[str], score: str) -> Column:
    """1 + the number of larger scores."""
    return F.rank().over(Window.partitionBy(*by).orderBy(F.desc_nulls_last(F.round(F.col(score), 9))))


def average_rank(by: list[str], value: str) -> Column:
    """Rank from the smallest value on, ties sharing their mean; for groups of bounded size, ranks() is for others."""
    same = Window.partitionBy(*by, value)
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count(F.lit(1)).over(same) - 1) / 2


def ranks(df: DataFrame, by: list[str], score: str, ident: str) -> DataFrame:
    """df with pos (largest score first, then the smaller id), rank (1 + the number of larger scores) and average_rank (smallest score first, ties sharing their mean), for groups of any size."""
    value = F.round(F.col(score), 9)
    rows = df.withColumn("__s", value)
    totals = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    cells = ordered_rows.tied(rows, by, "__s").select(*by, "__s", "n", "below", ordered_rows.average_rank().alias("average_rank"))
    placed = ordered_rows.place(rows, by, [F.desc_nulls_last("__s"), ident], "pos")
    placed = ordered_rows.matched(ordered_rows.matched(placed, cells, [*by, "__s"]), totals, by)
    rank = F.col("__n") - F.col("below") - F.col("n") + 1
    return placed.withColumn("rank", rank).drop("__s", "n", "below", "__n")


def top_k(df: DataFrame, by: list[str], score: str, ident: str, k: int) -> DataFrame:
    return df.withColumn("pos", position(by, score, ident)).where(F.col("pos") <= k)


def target_rank(scored: DataFrame, targets: DataFrame, by: list[str], score: str, ident: str, out: str) -> DataFrame:
    """(by, out): the position of each group's target among its rows; targets: (by or some of it, target)."""
    on = [c for c in by if c in targets.columns]
    joined = scored.join(targets, on)
    s = F.round(F.col(score), 9)
    own = joined.where(F.col(ident) == F.col("target")).groupBy(*by).agg(F.max(s).alias("__t"))
    both = joined.join(own, by)
    ahead = (s > F.col("__t")) | ((s == F.col("__t")) & (F.col(ident) < F.col("target")))
    return both.groupBy(*by).agg((F.count_if(ahead) + 1).alias(out))


def nested_top(df: DataFrame, by: list[str], score: str, ident: str, k: int, out: str = "topk") -> DataFrame:
    """One row a group: its first k rows as an ordered array of (pos, id, score)."""
    rows = top_k(df, by, score, ident, k)
    return rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", F.col(ident).alias("id"), F.col(score).alias("score")))).alias(out))
