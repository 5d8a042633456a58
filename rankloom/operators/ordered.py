"""Ranks, running sums and quantiles within groups, with no group in one task.

Rows are range-partitioned by group and order, so a group of any size spreads over as many tasks as its rows need. Each task sums along its sorted rows;
what comes before a task's first group is known from the totals of the tasks before it, of which only the groups that cross a partition border, one a border,
are joined back. Equal values are counted together first wherever they share a rank, so ties never make a long run of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from ..sources.scratch import new_path


def _keys(batch: pa.RecordBatch, names: list[str], last: tuple | None) -> tuple[np.ndarray, tuple]:
    """Where another group begins, and the group of the last row. last: that of the row before."""
    begins = np.zeros(batch.num_rows, bool)
    for name in names:
        codes = batch.column(name).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        begins[1:] |= codes[1:] != codes[:-1]
    begins[0] = last is None or last != tuple(batch.column(name)[0].as_py() for name in names)
    return begins, tuple(batch.column(name)[-1].as_py() for name in names)


def _scan(by: list[str], sums: dict[str, str], part: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row with the sums over the rows of its group before it in this partition."""
        last, carried, here = None, dict.fromkeys(sums, 0), TaskContext.get().partitionId()
        for b in batches:
            if not b.num_rows:
                continue
            begins, last = _keys(b, by, last)
            group = np.maximum.accumulate(np.where(begins, np.arange(1, len(begins) + 1), 0))  # 0: that of the batch before
            more = []
            for out, value in sums.items():
                v = b.column(value).to_numpy(zero_copy_only=False)
                whole = np.concatenate(([0], np.cumsum(v)))
                start = np.where(group > 0, whole[np.maximum(group - 1, 0)], -carried[out])
                more.append(pa.array(whole[:-1] - start, pa.int64()))
                carried[out] = int(whole[-1] - start[-1])
            arrays = [*b.columns, *more, pa.array(np.full(len(begins), here, np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, [*b.schema.names, *sums, part])

    return run


def running(df: DataFrame, by: list[str], order: list[Column | str], sums: dict[str, str]) -> DataFrame:
    """df with, for each (out, column) of sums, the sum of the whole-number column over the rows of the group that come before in the order.

    Null groups are groups; rows that the order doesn't tell apart follow each other in any one order. An empty table stays empty.
    """
    part, path = "__part", new_path(df.sparkSession, "ordered")
    ship(df.sparkSession)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + "".join(f", `{out}` long" for out in sums) + f", `{part}` int"
    ranged = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    scanned = ranged.mapInArrow(_scan(by, sums, part), kinds)
    scanned.write.parquet(path)  # written, as the partition numbers must be the same for both uses
    scanned = df.sparkSession.read.schema(scanned.schema).parquet(path)
    totals = scanned.groupBy(*by, part).agg(*[F.max(F.col(out) + F.col(v)).alias(out) for out, v in sums.items()])
    names = [f"__g{k}" for k in range(len(by))]
    earlier = Window.partitionBy(*[F.col(c) for c in by]).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(c).alias(g) for c, g in zip(by, names)], F.col(part).alias("__p"), *[F.sum(out).over(earlier).alias(f"__{out}") for out in sums])
    offsets = offsets.where(F.col(f"__{next(iter(sums))}").isNotNull())  # at most a row for each partition border
    on = [F.col(c).eqNullSafe(F.col(g)) for c, g in zip(by, names)] + [F.col(part) == F.col("__p")]
    joined = scanned.join(F.broadcast(offsets), on, "left")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *[(F.col(out) + F.coalesce(F.col(f"__{out}"), F.lit(0))).alias(out) for out in sums])


def matched(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """left with the other columns of right where by agrees, null with null; without by, right is one row."""
    if not by:
        return left.crossJoin(F.broadcast(right))
    names = [f"__m{k}" for k in range(len(by))]
    renamed = right.withColumnsRenamed(dict(zip(by, names)))
    return left.join(renamed, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(by, names)], how).drop(*names)


def place(df: DataFrame, by: list[str], order: list[Column | str], out: str) -> DataFrame:
    """df with the place of each row in its group, from 1."""
    counted = running(df.withColumn("__one", F.lit(1).cast("long")), by, order, {out: "__one"})
    return counted.withColumn(out, F.col(out) + 1).drop("__one")


def tied(df: DataFrame, by: list[str], value: str, **counts: Column) -> DataFrame:
    """(by, value, n, counts, below): a row for each distinct value, how many rows have it, further aggregates, and how many of the group are smaller; nulls first, NaN last."""
    cells = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in counts.items()])
    return running(cells, by, [value], {"below": "n"})


def average_rank() -> Column:
    """Of a row of tied(): the rank that its rows share, the smallest value first."""
    return F.col("below") + (F.col("n") + 1) / 2


def quantiles(df: DataFrame, by: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """(by, out, ...): exact quantiles, interpolated between neighbours, of the values that aren't null; groups without any are left out."""
    cells = tied(df.where(F.col(value).isNotNull()), by, value)
    totals = cells.groupBy(*by).agg(F.sum("n").alias("__n"))
    rows = matched(cells, totals, by)

    def at(index: Column) -> Column:
        """The value with so many before it."""
        return F.max(F.when((F.col("below") <= index) & (index < F.col("below") + F.col("n")), F.col(value).cast("double")))

    found = []
    for out, q in wanted.items():
        position = (F.col("__n") - 1) * F.lit(float(q))
        found += [at(F.floor(position)).alias(f"__lo_{out}"), at(F.ceil(position)).alias(f"__hi_{out}"), F.max(position - F.floor(position)).alias(f"__f_{out}")]
    mixed = [((1 - F.col(f"__f_{out}")) * F.col(f"__lo_{out}") + F.col(f"__f_{out}") * F.col(f"__hi_{out}")).alias(out) for out in wanted]
    return rows.groupBy(*by).agg(*found).select(*by, *mixed)
