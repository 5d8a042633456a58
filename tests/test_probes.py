"""Probes fitted together against a plain Newton fit of each."""

import numpy as np
import pytest

from rankloom.operators import probes, stats


def made(n=400, d=5, seed=0):
    rng = np.random.default_rng(seed)
    cell, y = rng.integers(0, 3, n), rng.random(n) < 0.3
    x = rng.normal(size=(n, d)) + np.outer(y, rng.normal(size=d)) + cell[:, None] * 0.5
    return x, y, cell


def plain(x, y, c=1.0):
    u, q = x - x.mean(0), np.where(y, len(y) / (2 * y.sum()), len(y) / (2 * (~y).sum()))
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-u @ w))
        g = (q * (p - y)) @ u + w / c
        w -= np.linalg.solve((u * (q * p * (1 - p))[:, None]).T @ u + np.eye(len(w)) / c, g)
    assert np.abs(g).max() < 1e-8
    return w


def frame(spark, x, y, cell, parts=4):
    rows = [(k, v.tolist(), bool(t), int(c)) for k, (v, t, c) in enumerate(zip(x, y, cell))]
    return spark.createDataFrame(rows, "id long, vec array<double>, y boolean, cell int").repartition(parts)


def test_unions_and_folds(spark):
    x, y, cell = made()
    models = [{0}, {1}, {2}, {0, 1}, {0, 2}, {1, 2}, {0, 1, 2}]
    w = probes.fit_all(frame(spark, x, y, cell), "vec", "y", "cell", models)
    for m, of in enumerate(models):
        on = np.isin(cell, list(of))
        assert np.allclose(w[m], plain(x[on], y[on]), atol=1e-6)


def test_separable_and_far_from_the_start(spark):
    x, y, cell = made(seed=3)
    x[:, 0] = np.where(y, 40.0, -40.0) + x[:, 0]
    w = probes.fit_all(frame(spark, x, y, cell), "vec", "y", "cell", [{0, 1, 2}], c=100.0)
    u = x - x.mean(0)
    q = np.where(y, len(y) / (2 * y.sum()), len(y) / (2 * (~y).sum()))
    p = 1 / (1 + np.exp(-u @ w[0]))
    assert np.abs((q * (p - y)) @ u + w[0] / 100).max() < 1e-5


def test_out_of_fold(spark):
    x, y, cell = made(300, 4, 2)
    df = frame(spark, x, y, cell)
    rows = probes.out_of_fold(df, "vec", "y", "id").collect()
    assert len(rows) == 300
    from rankloom.operators import sampling

    fold = {r.id: r.fold for r in sampling.folds(df, "y", "id", 42, 5).collect()}
    at = np.array([fold[k] for k in range(300)])
    for f in range(5):
        w = plain(x[at != f], y[at != f])
        for r in rows:
            if fold[r.id] == f:
                assert r.score == pytest.approx(float(x[r.id] @ w), abs=1e-5)
    (a,) = stats.auroc(probes.out_of_fold(df, "vec", "y", "id"), [], "score", "y").collect()
    assert 0.5 < a.auroc < 1.0


def test_odd(spark):
    x, y, cell = made(50, 3, 1)
    df = frame(spark, x, y, cell)
    extra = spark.createDataFrame([(100, None, True, 0), (101, [1.0, 2.0, 3.0], None, 0), (102, [1.0, 2.0, 3.0], True, None)], df.schema)
    assert np.allclose(probes.fit_all(df.union(extra), "vec", "y", "cell", [{0, 1, 2}]), probes.fit_all(df, "vec", "y", "cell", [{0, 1, 2}]))
    one_sided = probes.fit_all(df.where("y"), "vec", "y", "cell", [{0, 1, 2}])
    assert not one_sided.any() and probes.fit_all(df.limit(0), "vec", "y", "cell", [{0}]).shape == (1, 0)


def test_a_floor_holds_one_model_at_a_time(spark, monkeypatch):
    """Scores of a fold are written before the next is fitted; none of the five models is held by the scores."""
    rows = spark.createDataFrame([(k, f"word{k % 7} other{k % 3} same", float(k % 5), float(k % 2)) for k in range(60)], "doc_id long, text string, len double, label double")
    monkeypatch.setattr(stats, "auroc", lambda scores, *_: scores)
    out = probes.floor(rows, probes.length_model(), "doc_id")
    assert "UDF" not in out._jdf.queryExecution().analyzed().toString() and out.count() == 60
