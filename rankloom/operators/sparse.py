"""Sparse codes of vectors under an encoder, and the features that fire unevenly.

An encoder is a table (f, w, b): feature f of a vector is the positive part of w . vector + b. It is read in blocks of at most BLOCK numbers; for each block the vectors
pass once through a matrix product in Arrow batches. What leaves a task are the positive features of a vector, as a sparse row, or counts of firings, a row for each feature and task.
Rows take part whose key isn't null and whose vector has the encoder's width, without null or non-finite components.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..shipping import ship

#: Numbers of an encoder's rows that are sent out at once, and vectors that are multiplied at once.
BLOCK, ROWS = 4_000_000, 256


def _blocks(encoder: DataFrame, block: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(features, rows, biases) of bounded parts of the encoder, by feature."""
    held, room = [], 0
    for r in encoder.select("f", "w", "b").orderBy("f").toLocalIterator():
        held.append(r)
        room += len(r["w"])
        if room >= block:
            yield np.array([x["f"] for x in held]), np.array([x["w"] for x in held], float), np.array([x["b"] for x in held], float)
            held, room = [], 0
    if held:
        yield np.array([x["f"] for x in held]), np.array([x["w"] for x in held], float), np.array([x["b"] for x in held], float)


def _usable(vectors: DataFrame, key: str, vec: str, width: int) -> DataFrame:
    finite = F.forall(vec, lambda x: F.coalesce(F.abs(x) <= sys.float_info.max, F.lit(False)))
    return vectors.where(F.col(key).isNotNull() & (F.size(vec) == width) & finite)


def _products(batch: pa.RecordBatch, at: int, w: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, features of the rows from there on)."""
    for first in range(0, batch.num_rows, ROWS):
        part = batch.column(at).slice(first, ROWS)
        x = part.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(part), -1)
        yield first, np.maximum(x @ w.T + b, 0.0)


def codes(vectors: DataFrame, encoder: DataFrame, key: str, vec: str, block: int = BLOCK) -> DataFrame:
    """(key, at, a): the features of each vector that are over 0 and their values; a row for each vector and block of the encoder that has some."""
    spark, out = ship(vectors.sparkSession), None
    schema = StructType([StructField(key, vectors.schema[key].dataType), *StructType.fromDDL("at array<long>, a array<float>").fields])
    for f, w, b in _blocks(encoder, block):
        shared = spark.sparkContext.broadcast((f, w, b))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            f, w, b = shared.value
            for batch in batches:
                for first, a in _products(batch, 1, w, b):
                    row, on = np.nonzero(a)
                    some, begin = np.unique(row, return_index=True)
                    offsets = pa.array(np.append(begin, len(row)), pa.int32())
                    at, value = (pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (f[on].astype(np.int64), a[row, on].astype(np.float32)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first + some)), at, value], [key, "at", "a"])

        part = _usable(vectors, key, vec, w.shape[1]).select(key, vec).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def firing(vectors: DataFrame, encoder: DataFrame, key: str, vec: str, side: str, block: int = BLOCK) -> DataFrame:
    """(f, on, off): the share of vectors on the side, and off it, in which a feature is over 0; a null side counts on neither; null without any vector of a side."""
    spark, out = ship(vectors.sparkSession), None
    for f, w, b in _blocks(encoder, block):
        shared = spark.sparkContext.broadcast((f, w, b))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            f, w, b = shared.value
            fired, rows = np.zeros((2, len(f)), np.int64), np.zeros(2, np.int64)
            for batch in batches:
                sides = batch.column(1).cast(pa.int8()).fill_null(-1).to_numpy()
                for first, a in _products(batch, 0, w, b):
                    here = sides[first : first + len(a)]
                    for s in range(2):
                        fired[s] += (a[here == s] > 0).sum(axis=0)
                        rows[s] += (here == s).sum()
            if rows.any():
                yield pa.RecordBatch.from_arrays([pa.array(f.astype(np.int64)), *[pa.array(x) for x in fired], *[pa.array(np.full(len(f), n)) for n in rows]], ["f", "off", "on", "n_off", "n_on"])

        rows = _usable(vectors, key, vec, w.shape[1]).select(vec, F.col(side).cast("boolean").alias("side"))
        part = rows.mapInArrow(run, "f long, off long, on long, n_off long, n_on long")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "f long, on double, off double")
    sums = out.groupBy("f").agg(*[F.sum(c).alias(c) for c in ("on", "off", "n_on", "n_off")])
    return sums.select("f", F.try_divide("on", "n_on").alias("on"), F.try_divide("off", "n_off").alias("off"))


def direction(encoder: DataFrame, separation: DataFrame) -> DataFrame:
    """(i, v): the sum of the encoder's rows, weighted by (f, sep) of a few features."""
    rows = encoder.join(separation, "f").select("sep", F.posexplode("w").alias("i", "x"))
    return rows.groupBy("i").agg(F.sum(F.col("sep") * F.col("x")).alias("v"))
