"""Sparse codes and firing counts against dense products."""

import numpy as np
import pytest

from rankloom.operators import sparse


def made(n=700, d=6, features=40, seed=0):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, d)), rng.random(n) < 0.4, rng.normal(size=(features, d)), rng.normal(size=features) - 0.5


def frames(spark, x, y, w, b):
    odd = [(9000, None, True), (9001, [1.0] * 5, True), (9002, [1.0] * 5 + [None], True), (9003, [float("inf")] * 6, False), (None, [1.0] * 6, True)]
    rows = spark.createDataFrame([(k, v.tolist(), bool(s)) for k, (v, s) in enumerate(zip(x, y))] + odd, "id long, vec array<double>, side boolean").repartition(4)
    return rows, spark.createDataFrame([(10 * f, v.tolist(), float(t)) for f, (v, t) in enumerate(zip(w, b))], "f long, w array<double>, b double")


@pytest.mark.parametrize("block", [sparse.BLOCK, 60])
def test_against_dense(spark, block):
    x, y, w, b = made()
    rows, encoder = frames(spark, x, y, w, b)
    dense = np.maximum(x @ w.T + b, 0)
    got = {}
    for r in sparse.codes(rows, encoder, "id", "vec", block).collect():
        got.setdefault(r.id, {}).update(zip(r.at, r.a))
    want = {k: {10 * int(f): a[f] for f in np.flatnonzero(a)} for k, a in enumerate(dense) if a.any()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], rel=1e-5) for k in want)
    fires = {r.f: (r.on, r.off) for r in sparse.firing(rows, encoder, "id", "vec", "side", block).collect()}
    assert fires == {10 * f: pytest.approx(((dense[y, f] > 0).mean(), (dense[~y, f] > 0).mean())) for f in range(len(w))}


def test_direction(spark):
    x, y, w, b = made()
    _, encoder = frames(spark, x, y, w, b)
    sep = spark.createDataFrame([(0, 0.5), (30, -0.25)], "f long, sep double")
    got = {r.i: r.v for r in sparse.direction(encoder, sep).collect()}
    assert got == pytest.approx(dict(enumerate(0.5 * w[0] - 0.25 * w[3])))


def test_many_features(spark):
    """16,384 features of 64 components, in more than one block, without a row for a vector and a feature."""
    rng = np.random.default_rng(1)
    w = rng.normal(size=(16_384, 64))
    encoder = spark.createDataFrame([(f, v.tolist(), -20.0) for f, v in enumerate(w)], "f long, w array<double>, b double").repartition(8)
    x = rng.normal(size=(300, 64))
    rows = spark.createDataFrame([(k, v.tolist(), k % 2 == 0) for k, v in enumerate(x)], "id long, vec array<double>, side boolean")
    fires = {r.f: r.on for r in sparse.firing(rows, encoder, "id", "vec", "side", 600_000).collect()}
    dense = (x[::2] @ w.T - 20) > 0
    assert len(fires) == 16_384 and all(fires[f] == pytest.approx(dense[:, f].mean()) for f in range(0, 16_384, 511))


def test_empty(spark):
    x, y, w, b = made(20)
    rows, encoder = frames(spark, x, y, w, b)
    assert sparse.codes(rows.limit(0), encoder, "id", "vec").collect() == [] and sparse.codes(rows, encoder.limit(0), "id", "vec").collect() == []
    assert sparse.firing(rows, encoder.limit(0), "id", "vec", "side").collect() == []
