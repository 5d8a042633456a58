"""Column functions over array vectors; sums run in double."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column, eps: float = 0.0) -> Column:
    """a scaled to length 1; with eps it is added to the length, without it a zero vector gives null."""
    size = norm(a) + eps
    return F.when(size > 0, F.transform(a, lambda x: x.cast("double") / size))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def centred_cosine(a: Column, mean: Column, direction: Column, eps: float = 1e-8) -> Column:
    """Projection of a - mean on the unit direction, over the length of a - mean."""
    moved = minus(a, mean)
    return dot(moved, unit(direction)) / (norm(moved) + eps)


def finite(a: Column) -> Column:
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def argmax(a: Column) -> Column:
    """0-based place of the first largest element."""
    return F.array_position(a, F.array_max(a)).cast("int") - 1


def gather(a: Column, index: Column) -> Column:
    """Elements of a at 0-based places."""
    return F.transform(index, lambda i: F.element_at(a, i.cast("int") + 1))


def close(a: Column, b: Column, rel: float = 1e-6) -> Column:
    return F.abs(a - b) <= rel * F.greatest(F.abs(a), F.abs(b))


def sign_score(delta: Column) -> Column:
    return F.when(delta > 0, 1.0).when(delta < 0, 0.0).otherwise(0.5)


def explode(df: DataFrame, vec: str, *keep: str) -> DataFrame:
    """One row for each component: keep, i, x."""
    return df.select(*keep, F.posexplode(F.col(vec)).alias("i", "x")).withColumn("x", F.col("x").cast("double"))


def collect(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """The vectors of each key from rows (keys, i, value); a vector's length is bounded by its dimension."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", value))).alias("s")).select(*keys, F.transform("s", lambda e: e[value]).alias(out))


def mean_difference(df: DataFrame, vec: str, positive: Column, keys: list[str] = ()) -> DataFrame:
    """(keys, i, v): mean of the positive rows minus mean of the others, component by component."""
    rows = df.withColumn("__positive", positive)
    return explode(rows, vec, *keys, "__positive").groupBy(*keys, "i").agg((F.avg(F.when(F.col("__positive"), F.col("x"))) - F.avg(F.when(~F.col("__positive"), F.col("x")))).alias("v"))


def segment_mean(df: DataFrame, vec: str, keys: list[str], groups: DataFrame, size: int) -> DataFrame:
    """(keys, i, v) for every row of groups: the mean of its vectors, zeros for a group without any."""
    means = explode(df, vec, *keys).groupBy(*keys, "i").agg(F.avg("x").alias("v"))
    grid = groups.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    return grid.join(means, [*keys, "i"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


def hashed_normal(seed: Column, i: Column) -> Column:
    """A standard normal number from md5 of (seed, i), by Box and Muller."""
    word = lambda k: F.conv(F.substring(F.md5(F.concat_ws(":", seed.cast("string"), i.cast("string"))), 1 + 8 * k, 8), 16, 10).cast("double")
    return F.sqrt(-2 * F.log((word(0) + 1) / 4294967296.0)) * F.cos(2 * F.lit(3.141592653589793) * word(1) / 4294967296.0)
