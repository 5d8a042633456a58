import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import hilbert


def brute(rows, every=50, k=5, digits=12):
    """{query: [(score, id)]} over rows of (id, vector)."""
    rows = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)}
    ids = np.array([i for i, _ in rows])
    m = np.array([v for _, v in rows], float)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        s = unit @ unit[q]
        out[int(ids[q])] = [(s[j], int(ids[j])) for j in np.lexsort((ids, -np.round(s, digits))) if ids[j] != ids[q]][:k]
    return out


def recall(got, want):
    found = {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    return np.mean([i in found.get(q, ()) for q, near in want.items() for _, i in near])


def test_curve_is_continuous():
    for dims, bits in [(1, 4), (2, 4), (3, 3), (4, 2)]:
        side = 1 << bits
        grid = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = hilbert.hilbert_keys(grid, bits)
        assert sorted(key.tolist()) == list(range(side**dims))
        path = grid[np.argsort(key)].astype(int)
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_recall_on_tables(spark, sf):
    for d in (sf, "/root/testdata/sf0.1"):
        rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
        want, got = brute(rows), hilbert.query(spark, d).collect()
        assert len(got) == 5 * len(want) and recall(got, want) >= 0.9
        by = dict(rows)
        for r in got:
            a, b = np.array(by[r.query_id], float), np.array(by[r.vec_id], float)
            assert abs(r.score - a @ b / (np.linalg.norm(a) * np.linalg.norm(b))) < 1e-12
        for q in want:
            mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
            assert [r.rank for r in mine] == [1, 2, 3, 4, 5]
            assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)


def test_recall_on_clusters_needs_few_candidates(spark, monkeypatch):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(600, 16))
    m = centres[rng.integers(0, 600, 6000)] + 0.05 * rng.normal(size=(6000, 16))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    want = brute([(i, v.tolist()) for i, v in enumerate(m)])
    assert recall(hilbert.search(table, window=60).collect(), want) >= 0.9
    measured = []
    real = hilbert.window_for
    monkeypatch.setattr(hilbert, "window_for", lambda *a: measured.append(real(*a)) or measured[-1])
    assert recall(hilbert.search(table).collect(), want) >= 0.9
    assert measured[0] < 6000 / 25  # four curves see a third of the table, not all of it


@pytest.mark.parametrize("clusters, size, noise", [(2, 1500, 0.1), (2, 1500, 0.01), (2, 1500, 0.001), (2, 5000, 0.001), (2, 1500, 0.0003), (10, 300, 0.0001)])
def test_recall_on_close_vectors(spark, clusters, size, noise):
    """Far more vectors in a cluster than a shortlist holds, down to cosines that differ by a hundred-millionth."""
    rng = np.random.default_rng(clusters * size)
    m = np.repeat(rng.normal(size=(clusters, 32)), size, axis=0) + noise * rng.normal(size=(clusters * size, 32))
    rows = [(i, v.tolist()) for i, v in enumerate(m[rng.permutation(len(m))])]
    got = hilbert.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert recall(got, brute(rows, digits=16)) >= 0.9


def test_extreme_sizes(spark):
    """Vectors whose squares leave the range of doubles."""
    rng = np.random.default_rng(5)
    m = rng.normal(size=(120, 4))
    rows = [(i, (v * (1e200, 1e-200, 1.0)[i % 3]).tolist()) for i, v in enumerate(m)] + [(200, (m[0] * 1e200).tolist())]
    got = {}
    for r in sorted(hilbert.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    same = brute([(i, v.tolist()) for i, v in enumerate(m)] + [(200, (m[0] * (1 + 1e-15)).tolist())])
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for _, i in x] for q, x in same.items()}
    assert all(abs(a - b) < 1e-12 for q, x in got.items() for (_, a), (b, _) in zip(x, same[q]))


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    hot = [(i, [1.0, 2.0, 3.0]) for i in range(300, 340)]
    rows = [(0, [1.0, 0.0, 0.0]), (50, [2.0, 0.0, 0.0]), (1, [0.0, -0.0, 0.0]), (2, None), (3, [1.0, None, 0.0]), (4, [nan, 1.0, 1.0]), (5, [inf, 1.0, 1.0]), (100, [0.0, 0.0, 0.0]), (6, [1.0, 2.0]), (None, [1.0, 0.0, 0.0]), (7, [-0.0, 1.0, 0.0]), (8, [0.0, 1.0, 0.0]), (8, [0.0, 1.0, 0.0]), *hot]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("point", F.lit("x")).withColumn("rank", F.lit(1))
    got = hilbert.search(table).collect()
    near = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        near.setdefault(r.query_id, []).append(r.vec_id)
    assert near == {0: [50, 300, 301, 302, 303], 50: [0, 300, 301, 302, 303], 300: [301, 302, 303, 304, 305]}
    assert hilbert.search(table.limit(0)).collect() == []
    assert hilbert.search(table.where("vec_id = 0")).collect() == []
    few = hilbert.search(table.where("vec_id in (0, 7, 8)")).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in few) == [(0, 1, 7), (0, 2, 8)]
