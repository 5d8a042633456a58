"""Bootstrap weights that any task derives for its own units, without a table of draws.

A replicate draws n of n units with replacement. How often each is drawn comes from a tree over the numbers 0 to n - 1: a node's draws are split
between its halves by a binomial number, down to leaves of LEAF units, within which they fall on units at random. All numbers are keyed by (seed, node) and have a value for each replicate,
so a task that holds some units walks from the root to their leaves alone, and every metric over the same units sees the same resamples. No row is made for a unit and a replicate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from . import ordered

#: Units of a leaf at most.
LEAF = 4096


def _random(seed: int, low: int, high: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, low, high])))


def weights(n: int, b: int, seed: int, low: int, high: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first unit, counts of replicates x units) of each leaf that has units from low to high - 1."""
    walk = [(0, n, np.full(b, n, np.int64))]
    while walk:
        lo, hi, total = walk.pop()
        if hi <= low or lo >= high or lo == hi:
            continue
        random, size = _random(seed, lo, hi), hi - lo
        if size > LEAF:
            middle = lo + size // 2
            left = random.binomial(total, (middle - lo) / size)
            walk += [(middle, hi, total - left), (lo, middle, left)]  # the left half is next
        else:
            place = random.integers(0, size, total.sum()) + np.repeat(np.arange(b), total) * size
            yield lo, np.bincount(place, minlength=b * size).reshape(b, size)


def _sums(n: int, b: int, seed: int, keys: list[str], values: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each group of a batch and each replicate the weighted sums; rows come sorted by unit, so a batch meets few leaves."""
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = batch.column("unit").to_numpy()
            group = np.zeros(len(unit), np.int64)
            for k in keys:
                coded = batch.column(k).dictionary_encode(null_encoding="encode")
                group = group * len(coded.dictionary) + coded.indices.to_numpy(zero_copy_only=False)
            _, first, group = np.unique(group, return_index=True, return_inverse=True)
            sums = np.zeros((len(first), b, len(values)))
            x = np.stack([batch.column(v).to_numpy(zero_copy_only=False).astype(float) for v in values])
            for lo, counts in weights(n, b, seed, int(unit.min()), int(unit.max()) + 1):
                at = np.flatnonzero((unit >= lo) & (unit < lo + counts.shape[1]))
                for g in np.unique(group[at]).tolist():
                    mine = at[group[at] == g]
                    sums[g] += counts[:, unit[mine] - lo] @ x[:, mine].T
            names = [batch.column(k).take(pa.array(np.repeat(first, b))) for k in keys]
            columns = [pa.array(sums[:, :, k].ravel()) for k in range(len(values))]
            yield pa.RecordBatch.from_arrays([*names, pa.array(np.tile(np.arange(b), len(first))), *columns], [*keys, "b", *values])

    return run


def totals(units: DataFrame, n: int, b: int, seed: int, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, b, values): the sums of the values over each resample of the units, which are numbered from 0 to n - 1; null values count as 0."""
    ship(units.sparkSession)
    rows = units.select(*keys, F.col("unit").cast("long").alias("unit"), *[F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(v) for v in values])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema) + (", " if keys else "")
    ranged = rows.repartitionByRange("unit").sortWithinPartitions("unit")
    parts = ranged.mapInArrow(_sums(n, b, seed, keys, values), kinds + "b long, " + ", ".join(f"`{v}` double" for v in values))
    return parts.groupBy(*keys, "b").agg(*[F.sum(v).alias(v) for v in values])


def numbered_units(df: DataFrame, order: list[str]) -> DataFrame:
    """df with unit: the place of each row, from 0, in an order that tells rows apart."""
    return ordered.running(df.withColumn("__one", F.lit(1).cast("long")), [], order, {"unit": "__one"}).drop("__one")


def mean_interval(units: DataFrame, n: int, b: int, seed: int, keys: list[str], value: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(keys, mean, lo, hi): the mean of the value in each group, and percentiles of its means over the resamples that draw some of the group."""
    both = totals(units.withColumn("__n", F.lit(1.0)), n, b, seed, keys, [value, "__n"])
    means = both.withColumn("m", F.try_divide(value, F.col("__n"))).groupBy(*keys).agg(F.percentile("m", F.lit(low)).alias("lo"), F.percentile("m", F.lit(high)).alias("hi"))  # b rows a group
    return ordered.matched(units.groupBy(*keys).agg(F.avg(value).alias("mean")), means, keys)
