"""Splits, samples and draws in the order of md5(seed:key), the same in every run and engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import cut, new_path
from . import ordered


def order_key(seed, *keys: Column) -> Column:
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws(":", seed.cast("string"), *[k.cast("string") for k in keys]))


def grouped_split(df: DataFrame, key: str, seed: int, fraction: float = 0.8) -> DataFrame:
    """df with split: floor(fraction * keys) of the distinct keys, in hash order, are train; no key is on both sides. Null is a key."""
    keys = df.select(key).distinct()
    n = keys.agg(F.count("*").alias("n"))
    ranked = in_whole_order(keys, seed, key, out="__k").crossJoin(F.broadcast(n))  # one row
    split = ranked.select(key, F.when(F.col("__k") <= F.floor(fraction * F.col("n")), "train").otherwise("test").alias("split"))
    return ordered.matched(df, split, [key])


def in_whole_order(df: DataFrame, seed, key: str, out: str = "k") -> DataFrame:
    """df, whose keys are distinct, with the place of each row, from 1, in hash order over the whole table; numbered by range partition, in no single task."""
    keyed = df.withColumn("__h", F.concat_ws(":", order_key(seed, F.col(key)), F.col(key).cast("string")))
    return numbered(keyed, "__h", "__place").withColumn(out, F.col("__place") + 1).drop("__h", "__place")


def in_hash_order(df: DataFrame, by: list[str], seed, *keys: str, out: str = "k") -> DataFrame:
    """df with the place of each row, from 1, in hash order within its group, however large that is."""
    keyed = df.withColumn("__h", order_key(seed, *[F.col(k) for k in keys]))
    return ordered.place(keyed, by, ["__h", *keys], out).drop("__h")


def ring_draw(df: DataFrame, asked: DataFrame, key: str, group: str, seed: int) -> DataFrame:
    """(q, group, key, k): for every row (q, group, most) of asked, `most` rows of the group without replacement, k from 1; q itself is left out.

    Rows stand in a ring in hash order within their group; a draw takes the rows from a hashed start on. Only equi-joins, no pairs: the
    work is that of the table and of the rows drawn. Rows with a null key or group take no part; keys are unique; a group with fewer rows gives all.
    """
    name = F.concat(F.md5(F.col(group).cast("string")), order_key(seed, F.col(key)), F.lit(":"), F.col(key).cast("string"))
    keyed = df.where(F.col(key).isNotNull() & F.col(group).isNotNull()).select(key, group, name.alias("__h"))
    path = new_path(df.sparkSession, "ring")  # written, because it is read three times
    numbered(keyed, "__h", "__place").drop("__h").write.parquet(path)
    placed = df.sparkSession.read.parquet(path)
    sizes = placed.groupBy(group).agg(F.count("*").alias("__n"), F.min("__place").alias("__first"))
    start = F.conv(F.substring(order_key(seed, F.lit("start"), F.col("q")), 1, 8), 16, 10).cast("long") % F.col("__n")
    own = placed.select(F.col(key).alias("q"), group, F.col("__place").alias("__own"))
    rows = asked.join(sizes, group).join(own, ["q", group], "left").withColumn("__start", start)
    rows = rows.withColumn("__off", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("most").cast("long"), F.col("__n") - 1))))
    mine = F.pmod(F.col("__own") - F.col("__first") - F.col("__start"), F.col("__n"))
    k = F.col("__off") + 1 - F.coalesce((mine < F.col("__off")).cast("long"), F.lit(0))
    rows = rows.withColumn("k", k).where((F.col("k") <= F.col("most")) & (F.coalesce(mine, F.lit(-1)) != F.col("__off")))
    rows = rows.withColumn("__place", F.col("__first") + (F.col("__start") + F.col("__off")) % F.col("__n"))
    return rows.select("q", group, "__place", "k").join(placed, [group, "__place"]).select("q", group, key, "k")


def balance(df: DataFrame, by: list[str], seed: int, key: str) -> DataFrame:
    """As many rows of each group as the smallest group has."""
    least = df.groupBy(*by).count().agg(F.min("count").alias("__least"))
    return in_hash_order(df, by, seed, key, out="__k").crossJoin(F.broadcast(least)).where(F.col("__k") <= F.col("__least")).drop("__k", "__least")


def capped(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    return df.orderBy(order_key(seed, F.col(key)), key).limit(n)


def folds(df: DataFrame, label: str, key: str, seed: int, k: int) -> DataFrame:
    """df with fold: rows of a label dealt out in hash order."""
    return in_hash_order(df, [label], seed, key, out="__k").withColumn("fold", (F.col("__k") - 1) % k).drop("__k")


def dedup_first(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """Of rows that agree in columns the one with the smallest order."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*columns).orderBy(order))).where("__k = 1").drop("__k")


def dense_ids(df: DataFrame, key: str, out: str) -> DataFrame:
    """(key, out): the distinct values of key with their 0-based place in sorted order; DataFrame functions only.

    Values are range-partitioned and numbered within their partition; partition offsets are the only thing that is summed up in one place.
    """
    ranged = df.select(key).distinct().repartitionByRange(key).sortWithinPartitions(key)
    placed = cut(ranged.withColumn("__row", F.monotonically_increasing_id()), "dense")  # written, as the partition numbers must be the same for both uses
    part, within = F.shiftright("__row", 33), F.col("__row").bitwiseAND(F.lit((1 << 33) - 1))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))  # a row a partition
    return placed.join(F.broadcast(offsets), part == F.col("__part")).select(key, (F.col("__before") + within).alias(out))


def numbered(df: DataFrame, order: str, out: str) -> DataFrame:
    """df, whose values of order are distinct, with each row's 0-based place in that order; numbered by one scan of range partitions."""
    counted = ordered.running(df.withColumn("__one", F.lit(1).cast("long")), [], [order], {out: "__one"})
    return counted.drop("__one")


def resample_counts(df: DataFrame, b: int, n: int, seed: int) -> DataFrame:
    """(b, idx, w): how often each of n units, numbered from 0, is drawn in each of b resamples of size n; one table for all metrics."""
    spark = df.sparkSession
    drawn = spark.range(b).select(F.col("id").alias("b")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    idx = F.conv(F.substring(order_key(seed, F.col("b"), F.col("i")), 1, 8), 16, 10).cast("long") % n
    return drawn.select("b", idx.alias("idx")).groupBy("b", "idx").agg(F.count("*").alias("w"))
