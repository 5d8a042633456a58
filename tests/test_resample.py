"""Weights from the tree against their law, and what is summed with them against plain sums."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import resample


def whole(n, b, seed, low=0, high=None):
    out = np.zeros((b, n), np.int64)
    for lo, counts in resample.weights(n, b, seed, low, n if high is None else high):
        out[:, lo : lo + counts.shape[1]] = counts
    return out


@pytest.mark.parametrize("n", [1, 2, 100, 4096, 4097, 30_001])
def test_weights_of_a_replicate_sum_to_n(n):
    w = whole(n, 7, 3)
    assert (w.sum(axis=1) == n).all() and (w >= 0).all()
    assert n < 100 or not (w[0] == w[1]).all()


def test_a_task_sees_its_own_part_of_the_same_weights():
    n = 50_000
    w = whole(n, 5, 11)
    for low, high in [(0, 1), (12_345, 12_346), (20_000, 41_000), (49_999, 50_000)]:
        assert (whole(n, 5, 11, low, high)[:, low:high] == w[:, low:high]).all()
    assert not (whole(n, 5, 12) == w).all()


def test_law_of_the_weights():
    """Counts are nearly Poisson with mean 1 (chi-square over their values), and two leaves are negatively correlated as in a multinomial."""
    n, b = 20_000, 50
    w = whole(n, b, 5)
    seen = np.bincount(w.ravel(), minlength=8)[:7]
    law = np.exp(-1) / np.cumprod(np.concatenate(([1], np.arange(1, 7))))
    expected = law * n * b
    assert ((seen - expected) ** 2 / expected).sum() < 30  # 6 degrees of freedom; leaves of 4096 make it binomial rather than Poisson
    halves = whole(n, 400, 6)[:, : n // 2].sum(axis=1)
    assert abs(halves.mean() - n / 2) < 4 * np.sqrt(n / 4 / 400) and 0.8 < halves.var() / (n / 4) < 1.25


def test_sums_against_plain(spark):
    n, b = 9_000, 20
    x = [(k, "abc"[k % 3] if k % 7 else None, float(k % 11), None if k % 5 == 0 else k / 10) for k in range(n)]
    df = spark.createDataFrame(x, "unit long, g string, x double, y double").repartition(6)
    got = {(r.g, r.b): (r.x, r.y) for r in resample.totals(df, n, b, 9, ["g"], ["x", "y"]).collect()}
    w = whole(n, b, 9)
    for g in ("a", "b", "c", None):
        mine = [r for r in x if r[1] == g]
        at = [r[0] for r in mine]
        for k in range(b):
            assert got[g, k] == pytest.approx((float(w[k, at] @ [r[2] for r in mine]), float(w[k, at] @ [r[3] or 0.0 for r in mine])))
    (one,) = resample.totals(df.limit(0), 1, 1, 1, [], ["x"]).collect() or [None]
    assert one is None or one.x is None


def test_interval_is_that_of_the_mean(spark):
    n = 40_000
    x = np.random.default_rng(1).normal(10, 3, n)
    df = spark.createDataFrame([(k, "xy"[k % 2], float(v)) for k, v in enumerate(x)], "unit long, g string, x double").repartition(4)
    for r in resample.mean_interval(df, n, 300, 4, ["g"], "x").collect():
        mine = x["xy".index(r.g) :: 2]
        se = mine.std() / np.sqrt(len(mine))
        assert r.mean == pytest.approx(mine.mean()) and abs((r.hi - r.lo) / (2 * 1.96 * se) - 1) < 0.2 and r.lo < r.mean < r.hi


def test_ten_million_units_in_bounded_memory(spark):
    """Two billion draws, of which no row is made."""
    df = spark.range(10_000_000).select(F.col("id").alias("unit"), (F.col("id") % 10).cast("double").alias("x"))
    rows = resample.totals(df, 10_000_000, 20, 2, [], ["x"]).collect()
    assert len(rows) == 20 and all(abs(r.x / 10_000_000 - 4.5) < 0.01 for r in rows) and len({r.x for r in rows}) > 15
