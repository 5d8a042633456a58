"""Metrics over ranking and answer records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import std_or_zero


def rate(flag: Column) -> Column:
    return F.avg(flag.cast("double"))


def hit_rates(records: DataFrame, keys: list[str], ks: list[int]) -> DataFrame:
    """(keys, k, gold_rate, nf_rate, n) from records of (keys, gold_rank, nf_rank)."""
    wide = records.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    return wide.groupBy(*keys, "k").agg(rate(F.col("gold_rank") <= F.col("k")).alias("gold_rate"), rate(F.col("nf_rank") <= F.col("k")).alias("nf_rate"), F.count("*").alias("n"))


def mean_ranks(records: DataFrame, keys: list[str]) -> DataFrame:
    return records.groupBy(*keys).agg(F.avg("gold_rank").alias("gold_rank"), F.avg("nf_rank").alias("nf_rank"))


def baseline(value: str, by: list[str], at: str = "alpha10") -> Column:
    """The group's value where `at` is 0."""
    return F.max(F.when(F.col(at) == 0, F.col(value))).over(Window.partitionBy(*by))


def separation(means: DataFrame, by: list[str]) -> DataFrame:
    """Gains over alpha 0: gold_gain, nf_loss and their sum."""
    gains = means.withColumns({"gold_gain": baseline("gold_rank", by) - F.col("gold_rank"), "nf_loss": F.col("nf_rank") - baseline("nf_rank", by)})
    return gains.withColumn("separation", F.col("gold_gain") + F.col("nf_loss"))


def over_seeds(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Mean and deviation of each value over what is left of the keys; a single value has deviation 0."""
    return df.groupBy(*keys).agg(*[x for v in values for x in (F.avg(v).alias(f"{v}_mean"), std_or_zero(v).alias(f"{v}_std"))])


def alpha_scores(rates: DataFrame, by: list[str]) -> DataFrame:
    """(by, alpha10, score) for alpha > 0: mean over seeds and k of the gain in gold rate plus the fall in the other."""
    within = [*by, "seed", "k"]
    gains = rates.withColumn("gain", F.col("gold_rate") - baseline("gold_rate", within) + baseline("nf_rate", within) - F.col("nf_rate"))
    return gains.where("alpha10 > 0").groupBy(*by, "alpha10").agg(F.avg("gain").alias("score"))


def best(df: DataFrame, by: list[str], what: str, score: Column, out: str) -> DataFrame:
    """(by, out, best): what with the largest score, the smaller on a tie."""
    least = F.min(F.struct((-F.round(score, 9)).alias("s"), F.col(what).alias("w")))
    return df.groupBy(*by).agg(least.alias("m")).select(*by, F.col("m.w").alias(out), (-F.col("m.s")).alias("best"))
