"""Statistics of rankings and scores."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import ordered


def std_or_zero(value) -> Column:
    """Sample deviation; 0 for a single value."""
    return F.coalesce(F.stddev_samp(value), F.lit(0.0))


def auroc(df: DataFrame, by: list[str], score: str, positive: str) -> DataFrame:
    """(by, auroc) from average ranks: P(positive > other) + P(equal) / 2; null without both kinds. A null score is less than any other."""
    cells = ordered.tied(df, by, score, pos=F.count_if(F.col(positive)))
    n1, n = F.sum("pos"), F.sum("n")
    u = F.sum(F.col("pos") * ordered.average_rank()) - n1 * (n1 + 1) / 2
    return cells.groupBy(*by).agg(F.try_divide(u, (n1 * (n - n1)).cast("double")).alias("auroc"))


def balanced_at_zero(score: Column, positive: Column) -> Column:
    return (F.avg(F.when(positive, (score > 0).cast("double"))) + F.avg(F.when(~positive, (score <= 0).cast("double")))) / 2


def best_balanced(df: DataFrame, by: list[str], score: str, positive: str, ident: str) -> DataFrame:
    """(by, balanced): the best balanced accuracy over all cuts of the score order, either way round; equal scores are cut in id order."""
    y = F.col(positive).cast("long")
    rows = df.select(*by, score, ident, y.alias("__y"), (1 - y).alias("__z"))
    cuts = ordered.running(rows, by, [F.desc(score), ident], {"tp": "__y", "fp": "__z"}).select(*by, (F.col("tp") + F.col("__y")).alias("tp"), (F.col("fp") + F.col("__z")).alias("fp"))
    totals = df.groupBy(*by).agg(F.sum(y).alias("p"), F.sum(1 - y).alias("n"))
    rate = F.try_divide(F.col("tp"), F.col("p")) / 2 + (1 - F.try_divide(F.col("fp"), F.col("n"))) / 2
    both = cuts.join(totals, by) if by else cuts.crossJoin(F.broadcast(totals))
    return both.withColumn("a", rate).groupBy(*by).agg(F.greatest(F.max("a"), 1 - F.min("a"), F.lit(0.5)).alias("balanced"))


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, rho) from average ranks of the two columns."""
    rows = df.groupBy(*by, x, y).agg(F.count(F.lit(1)).alias("__n"))
    for value, out in ((x, "__x"), (y, "__y")):
        rows = ordered.matched(rows, ordered.tied(df, by, value).select(*by, value, ordered.average_rank().alias(out)), [*by, value])
    middle = rows.groupBy(*by).agg(((F.sum("__n") + 1) / 2).alias("__m"))
    n, a, b = F.col("__n"), F.col("__x") - F.col("__m"), F.col("__y") - F.col("__m")
    rows = ordered.matched(rows, middle, by)
    return rows.groupBy(*by).agg(F.try_divide(F.sum(n * a * b), F.sqrt(F.sum(n * a * a)) * F.sqrt(F.sum(n * b * b))).alias("rho"))


def bootstrap_means(units: DataFrame, draws: DataFrame, keys: list[str], value: str, n: int) -> DataFrame:
    """(keys, b, mean): the mean of value over each resample; units: (keys, idx, value)."""
    return units.join(draws, "idx").groupBy(*keys, "b").agg((F.sum(F.col("w") * F.col(value)) / F.lit(float(n))).alias("mean"))


def interval(means: DataFrame, keys: list[str], value: str = "mean", low: float = 0.025, high: float = 0.975) -> DataFrame:
    return means.groupBy(*keys).agg(F.percentile(value, F.lit(low)).alias("lo"), F.percentile(value, F.lit(high)).alias("hi"))


def two_sided(delta: Column) -> Column:
    """Bootstrap p-value of a difference."""
    return F.least(F.lit(1.0), 2 * F.least(F.avg((delta <= 0).cast("double")), F.avg((delta >= 0).cast("double"))))


def signed_ranks(df: DataFrame, by: list[str], delta: str) -> DataFrame:
    """(by, n, w_plus, w_minus, variance) of the signed-rank test; ranks of zeros go half to either side."""
    d = F.col(delta)
    cells = ordered.tied(df.withColumn("__a", F.abs(delta)), by, "__a", up=F.count_if(d > 0), down=F.count_if(d < 0), none=F.count_if(d == 0)).withColumn("__r", ordered.average_rank())
    t, half = F.col("n"), F.col("none") / 2
    sums = cells.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.col("__r") * (F.col("up") + half)).alias("w_plus"), F.sum(F.col("__r") * (F.col("down") + half)).alias("w_minus"), F.sum(t * t * t - t).alias("ties"))
    full = F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) / 24 - F.col("ties") / 48
    return sums.withColumn("variance", full).drop("ties")


@F.pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    """Two-sided p-value of a standard normal statistic."""
    return z.map(lambda x: math.erfc(abs(x) / math.sqrt(2)) if x == x else math.nan)


def wilcoxon(df: DataFrame, by: list[str], delta: str) -> DataFrame:
    """signed_ranks with z and p; p is 1 if every difference is 0."""
    ranks = signed_ranks(df, by, delta)
    z = F.try_divide(F.col("w_plus") - F.col("n") * (F.col("n") + 1) / 4, F.sqrt("variance"))
    return ranks.withColumn("z", F.when(F.col("w_plus") == F.col("w_minus"), 0.0).otherwise(z)).withColumn("p", normal_p("z"))


def density(points: DataFrame, grid: DataFrame, value: str, width: float) -> DataFrame:
    """(x, density) of a Gaussian kernel at the points of a small grid."""
    k = F.exp(-0.5 * F.pow((F.col("x") - F.col(value)) / width, 2)) / (width * 2.5066282746310002)
    return points.crossJoin(F.broadcast(grid)).groupBy("x").agg(F.avg(k).alias("density"))
