"""Linear probes by Newton steps over all of their unions and folds at once; the floor of lengths by pyspark.ml."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as fv
from ..shipping import ship
from ..sources.scratch import cut
from . import sampling, stats


def weighted(df: DataFrame, label: str) -> DataFrame:
    """df with weight: classes weigh alike in total."""
    n = df.groupBy(label).agg(F.count("*").alias("__n"))
    total = df.agg(F.count("*").alias("__t"))
    return df.join(F.broadcast(n), label).crossJoin(F.broadcast(total)).withColumn("weight", F.col("__t") / (2 * F.col("__n"))).drop("__n", "__t")  # two rows, one row


#: Newton steps end when no model's gradient has a component over this.
TOLERANCE, MOST_STEPS = 1e-6, 50


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each cell and side: rows and the sum of their vectors."""
    for b in batches:
        if b.num_rows:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            y, cell = b.column(1).to_numpy(zero_copy_only=False).astype(int), b.column(2).to_numpy()
            for c, side in sorted(set(zip(cell.tolist(), y.tolist()))):
                on = (cell == c) & (y == side)
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([side], pa.int32()), pa.array([int(on.sum())]), pa.array([x[on].sum(0).tobytes()])], ["cell", "side", "n", "sum"])


def _steps(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each model the sum over its rows of loss, gradient and Hessian at its weights."""
        members, mean, weight, w = shared.value
        models, d = w.shape
        loss, g, h = np.zeros(models), np.zeros((models, d)), np.zeros((models, d, d))
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            y, cell = b.column(1).to_numpy(zero_copy_only=False).astype(int), b.column(2).to_numpy()
            for m in range(models):
                on = members[m, cell]
                u = x[on] - mean[m]
                z, side = u @ w[m], y[on]
                q = weight[m, side]
                p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                loss[m] += (q * np.logaddexp(0, np.where(side == 1, -z, z))).sum()
                g[m] += (q * (p - side)) @ u
                h[m] += (u * (q * p * (1 - p))[:, None]).T @ u
        for m in range(models):
            yield pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), pa.array([np.concatenate(([loss[m]], g[m], h[m].ravel())).tobytes()])], ["model", "sums"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for m, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            sums[m] = sums.get(m, 0.0) + np.frombuffer(x)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()])], ["model", "sums"])


def fit_all(df: DataFrame, vec: str, label: str, cell: str, models: list[set[int]], c: float = 1.0) -> np.ndarray:
    """Weights (models x components) of logistic probes on vectors centred by each model's mean, without intercept, classes weighing alike, squared penalty 1 / (2c).

    Rows belong to a cell, a small number; a model is a set of cells. All models are fitted together: a Newton step of all of them is one pass over the rows. Vectors have one length,
    rows with a null vector, label or cell take no part; a model without rows on both sides has weights of 0. Models and cells are a grid of stated size.
    """
    spark = ship(df.sparkSession)
    rows = df.select(F.col(vec).cast("array<double>").alias("x"), F.col(label).cast("boolean").alias("y"), F.col(cell).cast("int").alias("cell")).where("x is not null and y is not null and cell is not null")
    known = {}
    for r in rows.mapInArrow(_moments, "cell int, side int, n long, sum binary").collect():  # a row for each cell, side and batch of rows
        n, total = known.get((r["cell"], r["side"]), (0, 0.0))
        known[r["cell"], r["side"]] = n + r["n"], total + np.frombuffer(r["sum"])
    d = max((len(x) for _, x in known.values()), default=0)
    cells = 1 + max((k for k, _ in known), default=0)
    members = np.array([[k in m for k in range(cells)] for m in models])
    mean, weight = np.zeros((len(models), d)), np.ones((len(models), 2))
    fitted = np.zeros(len(models), bool)
    for m, of in enumerate(models):
        n = [sum(known[k, side][0] for k in of if (k, side) in known) for side in (0, 1)]
        fitted[m] = min(n) > 0
        if fitted[m]:
            mean[m] = sum(x for (k, _), (_, x) in known.items() if k in of) / sum(n)
            weight[m] = sum(n) / (2 * np.array(n))
    members &= fitted[:, None]
    w, step, before = np.zeros((len(models), d)), np.zeros((len(models), d)), np.full(len(models), np.inf)
    for _ in range(MOST_STEPS if fitted.any() else 0):
        shared = spark.sparkContext.broadcast((members, mean, weight, w))
        found = rows.mapInArrow(_steps(shared), "model int, sums binary").repartition(min(len(models), 64), "model").mapInArrow(_added, "model int, sums binary").collect()  # a row a model
        shared.destroy()
        w, worst = w.copy(), 0.0
        for r in found:
            m, sums = r["model"], np.frombuffer(r["sums"])
            if not fitted[m]:
                continue
            loss, g, h = sums[0] + w[m] @ w[m] / (2 * c), sums[1 : d + 1] + w[m] / c, sums[d + 1 :].reshape(d, d) + np.eye(d) / c
            if loss > before[m] + 1e-9 * abs(before[m]):  # too far: half of the step back
                step[m] /= 2
                w[m] -= step[m]
                worst = np.inf
                continue
            before[m], largest = loss, np.abs(g).max()
            if largest > TOLERANCE:
                step[m] = -np.linalg.solve(h, g)
                w[m] += step[m]
            worst = max(worst, largest)
        if worst <= TOLERANCE:
            break
    return w


def probe(df: DataFrame, vec: str, label: str, c: float = 1.0) -> np.ndarray:
    """The weights of a single probe over all rows; they are the direction."""
    return fit_all(df.withColumn("__cell", F.lit(0)), vec, label, "__cell", [{0}], c)[0]


def out_of_fold(df: DataFrame, vec: str, label: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """(key, label, score): every row scored by a probe that has not seen its fold; the k probes are fitted together."""
    rows = cut(sampling.folds(df.select(key, vec, label), label, key, seed, k), "folds")
    w = fit_all(rows, vec, label, "fold", [set(range(k)) - {fold} for fold in range(k)])
    by_fold = F.array(*[F.array(*map(F.lit, x.tolist())) for x in w])
    return rows.select(key, label, fv.dot(F.col(vec), F.get(by_fold, F.col("fold").cast("int"))).alias("score"))


def length_model() -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=["len"], outputCol="features"), LogisticRegression(maxIter=30, weightCol="weight")])


def floor(df: DataFrame, model: Pipeline, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """(auroc) of out-of-fold scores of a text model over (key, text, len, label); both classes weigh alike in every fit."""
    rows = sampling.folds(df, "label", key, seed, k)
    out = None
    for fold in range(k):
        fitted = model.fit(weighted(rows.where(F.col("fold") != fold), "label"))
        part = fitted.transform(rows.where(F.col("fold") == fold)).select((F.col("label") > 0).alias("y"), vector_to_array("probability")[1].alias("score"))
        part = cut(part, "floor")  # written, so that no more than one fold's model is held
        out = part if out is None else out.union(part)
    return stats.auroc(out, [], "score", "y")
