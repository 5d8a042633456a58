"""Ranks, running sums and quantiles over split groups against plain versions."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import ordered, ranking, sampling, stats


def rows_of(n, seed=0, values=7, groups=3):
    rng = np.random.default_rng(seed)
    return [(("a", "b", None, "c")[int(rng.integers(0, groups))], float(rng.integers(0, values)), bool(rng.integers(0, 2)), k) for k in range(n)]


def frame(spark, rows, parts=5):
    return spark.createDataFrame(rows, "g string, s double, y boolean, id long").repartition(parts)


def groups(rows):
    out = defaultdict(list)
    for r in rows:
        out[r[0]].append(r)
    return out


def plain_average_ranks(values):
    return [sum(w < v for w in values) + (sum(w == v for w in values) + 1) / 2 for v in values]


def plain_auroc(rows):
    p, n = [r[1] for r in rows if r[2]], [r[1] for r in rows if not r[2]]
    return sum((a > b) + (a == b) / 2 for a in p for b in n) / (len(p) * len(n)) if p and n else None


@pytest.mark.parametrize("rows", [rows_of(400), rows_of(300, 1, 200), [("a", 1.0, k % 3 == 0, k) for k in range(500)], rows_of(3, 2)], ids=["ties", "few ties", "all tied", "tiny"])
def test_statistics(spark, rows):
    df, of = frame(spark, rows), groups(rows)
    assert {r.g: pytest.approx(r.auroc) if r.auroc is not None else None for r in stats.auroc(df, ["g"], "s", "y").collect()} == {g: plain_auroc(x) for g, x in of.items()}
    (whole,) = stats.auroc(df, [], "s", "y").collect()
    assert whole.auroc == (pytest.approx(plain_auroc(rows)) if plain_auroc(rows) is not None else None)
    for r in stats.best_balanced(df, ["g"], "s", "y", "id").collect():
        x = sorted(of[r.g], key=lambda t: (-t[1], t[3]))
        p, n = sum(t[2] for t in x), sum(not t[2] for t in x)
        if p and n:
            at = [sum(t[2] for t in x[: k + 1]) / p / 2 + (1 - sum(not t[2] for t in x[: k + 1]) / n) / 2 for k in range(len(x))]
            assert r.balanced == pytest.approx(max(max(at), 1 - min(at), 0.5))
    other = df.withColumn("t", (F.col("id") * 7 % 11).cast("double"))
    for r in stats.spearman(other, ["g"], "s", "t").collect():
        a, b = (plain_average_ranks(v) for v in ([t[1] for t in of[r.g]], [t[3] * 7 % 11 for t in of[r.g]]))
        want = np.corrcoef(a, b)[0, 1] if len(a) > 1 and len(set(a)) > 1 and len(set(b)) > 1 else None
        assert r.rho == (pytest.approx(want) if want is not None else None)


def test_ranks(spark):
    rows = rows_of(300, 3, 9, 4)
    got = {r.id: r for r in ranking.ranks(frame(spark, rows), ["g"], "s", "id").collect()}
    for x in groups(rows).values():
        order = sorted(x, key=lambda t: (-t[1], t[3]))
        for (g, s, _, k), average in zip(x, plain_average_ranks([t[1] for t in x])):
            assert (got[k].pos, got[k].rank, got[k].average_rank) == (order.index((g, s, _, k)) + 1, 1 + sum(t[1] > s for t in x), average)


def test_signed_ranks(spark):
    rows = [(g, float((k * 5) % 9 - 4), True, k) for k in range(120) for g in "ab"]
    for r in stats.signed_ranks(frame(spark, rows), ["g"], "s").collect():
        d = [t[1] for t in rows if t[0] == r.g]
        ranks = plain_average_ranks([abs(v) for v in d])
        assert r.w_plus == sum(k * (1 if v > 0 else 0.5 if v == 0 else 0) for k, v in zip(ranks, d)) and r.w_plus + r.w_minus == len(d) * (len(d) + 1) / 2


def test_running_sums_cross_partitions(spark):
    """One group over all partitions, others within one, null among them."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(None if k % 50 == 0 else "big" if k % 10 else f"s{k}", float(k % 3), bool(k % 2), k) for k in range(2000)]
        df = frame(spark, rows, 9).withColumn("w", F.col("id") % 4)
        got = ordered.running(df, ["g"], [F.desc("id")], {"before": "w"})
        assert got.columns == ["g", "s", "y", "id", "w", "before"]
        by = defaultdict(int)
        want = {}
        for g, _, _, k in sorted(rows, key=lambda t: -t[3]):
            want[k] = by[g]
            by[g] += k % 4
        assert {r.id: r.before for r in got.collect()} == want
        assert sorted(r.k for r in ordered.place(df, [], ["id"], "k").collect()) == [*range(1, 2001)]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_quantiles(spark):
    rows = rows_of(500, 5, 40, 4) + [("nulls", None, True, 900), ("one", 3.5, True, 901), ("a", None, True, 902)]
    wanted = {"lo": 0.025, "mid": 0.5, "hi": 0.975, "least": 0.0, "most": 1.0}
    got = {r.g: r for r in ordered.quantiles(frame(spark, rows), ["g"], "s", wanted).collect()}
    assert set(got) == {t[0] for t in rows if t[1] is not None}
    for g, r in got.items():
        x = [t[1] for t in rows if t[0] == g and t[1] is not None]
        assert all(getattr(r, k) == pytest.approx(np.quantile(x, q)) for k, q in wanted.items())
    (whole,) = ordered.quantiles(frame(spark, rows), [], "s", wanted).collect()
    assert whole.mid == np.median([t[1] for t in rows if t[1] is not None])


def test_empty_and_odd(spark):
    none = frame(spark, rows_of(5)).limit(0)
    assert stats.auroc(none, ["g"], "s", "y").collect() == [] and ordered.quantiles(none, ["g"], "s", {"m": 0.5}).collect() == []
    assert ordered.place(none, ["g"], ["id"], "k").collect() == []
    odd = frame(spark, [("a", math.nan, True, 1), ("a", None, False, 2), ("a", 1.0, False, 3), ("a", math.inf, True, 4)])
    (r,) = stats.auroc(odd, ["g"], "s", "y").collect()
    assert r.auroc == 1.0  # null first, NaN last


def test_places_in_hash_order(spark):
    rows = rows_of(200, 7, 5, 4)
    got = sampling.in_hash_order(frame(spark, rows), ["g"], 3, "id").collect()
    import hashlib

    for g, x in groups(rows).items():
        order = sorted((t[3] for t in x), key=lambda k: hashlib.md5(f"3:{k}".encode()).hexdigest())
        assert [r.id for r in sorted((r for r in got if r.g == g), key=lambda r: r.k)] == order


def test_no_window_over_a_group(spark, sf):
    """The plans order rows by range; the only window is over the totals of partitions."""
    from rankloom.plans import catalogue

    for name in ("claim_auroc", "quality_auroc", "balanced_accuracy", "spearman", "rank_position_vs_competition", "kfold_assign", "class_balance", "lineitem_percentiles", "null_permutation"):
        plan = catalogue.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if " Window [" in line or line.lstrip(" :+-").startswith("Window [")]
        assert all("__part" in line or "__p" in line for line in windows), (name, windows)
