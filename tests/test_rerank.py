"""The two-pass re-ranking and the draws from a ring against plain versions."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankloom.operators import ranking, rerank, sampling
from rankloom.plans import catalogue

SCHEMA = "vec_id long, vec array<double>, fact boolean, extra string"
ALPHAS = (0, 5, 10)


@pytest.fixture(scope="module")
def made():
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist(), bool(i % 3), "x") for i in range(90)]
    rows += [(100 + i, rows[i][1], rows[i][2], None) for i in range(0, 40, 2)]  # ties
    width = [(300, rows[3][1][:4], True, "x"), (320, rows[4][1] + [0.5, 1.0], True, "x"), (340, rows[6][1][:5] + [None], False, "x"), (360, rows[6][1][:5] + [float("nan")], False, "x"), (361, rows[6][1][:5] + [float("inf")], False, "x"), (362, [], True, "x")]  # none takes part
    return rows + width + [(200, None, True, "x"), (None, rows[0][1], True, "x"), (220, rows[5][1], None, "x")], [rng.normal(size=6).tolist() for _ in range(2)]


def plain(rows, directions):
    """{(q, dir, alpha10): (ordered ids, gold rank, nf rank)}"""
    rows = [r for r in rows if r[0] is not None and r[1] is not None and len(r[1]) == 6 and None not in r[1] and np.isfinite(r[1]).all()]
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    unit, out = v / np.linalg.norm(v, axis=1, keepdims=True), {}
    for at, (q, _, side, _) in enumerate(rows):
        if q % 20:
            continue
        cos, other = unit @ unit[at], ids != q
        zc = (cos - cos[other].mean()) / cos[other].std()
        nearest = lambda ok: min((-round(cos[j], 9), ids[j]) for j in range(len(rows)) if other[j] and ok(rows[j][2]))[1]  # noqa: B023, E731
        targets = None if side is None else (nearest(lambda f: f == side), nearest(lambda f: f is not None and f != side))  # noqa: B023
        for d, w in enumerate(directions):
            p = v @ np.array(w)
            for a in ALPHAS:
                s = np.round((1 - a / 10) * zc + a / 10 * (p - p.mean()) / p.std(), 9)
                order = [int(ids[j]) for j in sorted(np.flatnonzero(other), key=lambda j: (-s[j], ids[j]))]  # noqa: B023
                out[q, d, a] = order, *(order.index(t) + 1 if targets else None for t in targets or (0, 0))
    return out


@pytest.mark.parametrize("numbers", [4_000_000, 120])
def test_ranks_and_first_rows(spark, made, monkeypatch, numbers):
    rows, directions = made
    monkeypatch.setattr(ranking, "BROADCAST_NUMBERS", numbers)  # 120: several blocks of queries
    monkeypatch.setattr(rerank, "ASKED", 2)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = plain(rows, directions)
    got = rerank.target_ranks(docs, docs.where("vec_id % 20 = 0"), directions, ALPHAS).collect()
    assert {(r.q, r.dir, r.alpha10): (r.gold_rank, r.nf_rank) for r in got} == {k: x[1:] for k, x in want.items() if x[1]}
    top = rerank.fused_top(docs, docs.where("vec_id % 20 = 0"), directions, ALPHAS, 4).collect()
    firsts = {}
    for r in sorted(top, key=lambda r: r.pos):
        firsts.setdefault((r.q, r.dir, r.alpha10), []).append(r.id)
    assert firsts == {k: x[0][:4] for k, x in want.items()} and len(top) == 4 * len(want)


def test_empty_tables(spark, made):
    docs, none = spark.createDataFrame(made[0], SCHEMA), spark.createDataFrame([], SCHEMA)
    assert rerank.target_ranks(docs, none, made[1], ALPHAS).count() == 0
    assert rerank.fused_top(none, docs, made[1], ALPHAS, 3).count() == 0


def test_ring_draw(spark):
    rows = [(i, "a" if i % 4 else "b") for i in range(60)] + [(100, None), (None, "a"), (101, "lone")]
    df = spark.createDataFrame(rows, "id long, g string")
    asked = df.where("id % 20 = 0 or id = 101").select(F.col("id").alias("q"), F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("lone"))).alias("g"), F.lit(16).alias("most"))
    got = sampling.ring_draw(df, asked, "id", "g", 5).collect()
    groups = {g: {i for i, x in rows if x == g and i is not None} for g in ("a", "b", "lone")}
    for q in (0, 20, 40, 100, 101):
        for g, members in groups.items():
            own = [r for r in got if r.q == q and r.g == g]
            have, most = [r.id for r in own], min(16, len(members - {q}))
            assert len(have) == len(set(have)) == most and set(have) <= members - {q}
            assert sorted(r.k for r in own) == list(range(1, most + 1))
    assert got and sorted(map(tuple, got)) == sorted(map(tuple, sampling.ring_draw(df.repartition(5), asked, "id", "g", 5).collect()))


def test_a_tail_is_projected_and_not_compared(spark, made):
    """Scores as a component of their own: the cosines stay, the scores are the projections."""
    rows, _ = made
    rng = np.random.default_rng(9)
    good = [r for r in rows if r[0] is not None and r[1] is not None and len(r[1]) == 6 and None not in r[1] and np.isfinite(r[1]).all()]
    scores = rng.random(len(good))
    longer = spark.createDataFrame([(r[0], [*r[1], float(s)], r[2], r[3]) for r, s in zip(good, scores)], SCHEMA)
    got = {(r.q, r.alpha10): r.id for r in rerank.fused_top(longer, longer.where("vec_id % 20 = 0"), [[0.0] * 6 + [1.0]], ALPHAS, 1, tail=1).collect()}
    v = np.array([r[1] for r in good])
    ids, unit, z = np.array([r[0] for r in good]), v / np.linalg.norm(v, axis=1, keepdims=True), (scores - scores.mean()) / scores.std()
    for at in np.flatnonzero(ids % 20 == 0):
        cos, other = unit @ unit[at], ids != ids[at]
        zc = (cos - cos[other].mean()) / cos[other].std()
        for a in ALPHAS:
            s = np.round((1 - a / 10) * zc + a / 10 * z, 9)
            assert got[int(ids[at]), a] == min((-s[j], ids[j]) for j in np.flatnonzero(other))[1]


def test_each_combination_is_computed_once(spark, made, monkeypatch):
    """Ranks and first rows are written, so reading them twice doesn't run the passes again; queries ask only for the part of the grid that they look at."""
    docs = spark.createDataFrame(made[0], SCHEMA)
    for out in (rerank.target_ranks(docs, docs.where("vec_id % 20 = 0"), made[1], ALPHAS), rerank.fused_top(docs, docs.where("vec_id % 20 = 0"), made[1], ALPHAS, 3)):
        assert "MapInArrow" not in out._jdf.queryExecution().toString()
    asked = []

    def ranks(docs, queries, directions, alphas, tail=0):
        asked.append((len(directions), tuple(alphas)))
        return spark.createDataFrame([], "q long, dir int, alpha10 int, gold_rank long, nf_rank long")

    monkeypatch.setattr(rerank, "target_ranks", ranks)
    for name in ("method_verdict", "series_extract", "layer_coverage", "best_layer_abs", "run_comparison", "fallback_selection", "old_new_diff"):
        catalogue.queries()[name](spark, "/root/testdata/sf0.001").collect()
    assert asked == [(10, (5,)), (1, (0, 3, 5, 10)), (19, (0,)), (20, (5,)), (8, (0, 3, 5, 10)), (20, (0, 3, 5, 10)), (20, (0, 3, 5, 10))]


def test_copies_and_close_scores(spark):
    """Many copies of one vector and vectors closer than single precision tells apart, in several slices of documents."""
    rng = np.random.default_rng(11)
    base = rng.normal(size=6)
    rows = [(i, rng.normal(size=6).tolist(), bool(i % 2), "x") for i in range(300)] + [(i, base.tolist(), bool(i % 3), "x") for i in range(300, 700)]
    rows += [(i, (base + 1e-8 * rng.normal(size=6)).tolist(), bool(i % 2), "x") for i in range(700, 900)]
    directions = [rng.normal(size=6).tolist() for _ in range(2)] + [[0.0] * 6]  # the last is flat: nothing is ahead of anything
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = plain(rows, directions[:2])
    got = {(r.q, r.dir, r.alpha10): (r.gold_rank, r.nf_rank) for r in rerank.target_ranks(docs, docs.where("vec_id % 20 = 0"), directions, ALPHAS).collect()}
    assert {k: x for k, x in got.items() if k[1] < 2} == {k: x[1:] for k, x in want.items()}
    assert {x for k, x in got.items() if k[1] == 2} == {(1, 1)}
    top = {}
    for r in rerank.fused_top(docs, docs.where("vec_id % 20 = 0"), directions, ALPHAS, 4).orderBy("pos").collect():
        top.setdefault((r.q, r.dir, r.alpha10), []).append(r.id)
    assert top == {k: x[0][:4] for k, x in want.items()}


def test_directions_alike_share_a_bound(spark):
    """Counts of crowded and of sparse tiles, of directions that share a bound and of others; a task sends one row a query, not one a combination."""
    rng = np.random.default_rng(17)
    rows = [(i, (rng.normal(size=6) * (40 if i == 7 else 1)).tolist(), bool(i % 2), "x") for i in range(1200)]
    rows += [(1200 + i, rows[i][1], rows[i][2], "x") for i in range(0, 60, 3)]
    base = rng.normal(size=6)
    directions = [(base + 0.2 * rng.normal(size=6)).tolist() for _ in range(3)] + [(-base).tolist(), [0.0] * 6]
    assert [(a, g.tolist(), stands.tolist()) for a, g, stands in rerank._together(np.array(directions), (0, 5, 10), np.array([False] * 4 + [True]))] == [(0, [0], [0, 1, 2, 3]), (1, [0, 1, 2], [0, 1, 2]), (1, [3], [3])]
    docs, sent = spark.createDataFrame(rows, SCHEMA).repartition(2), []
    want = plain(rows, directions[:4])
    got = {(r.q, r.dir, r.alpha10): (r.gold_rank, r.nf_rank) for r in rerank.target_ranks(docs, docs.where("vec_id % 20 = 0"), directions, ALPHAS).collect()}
    assert {k: x for k, x in got.items() if k[1] < 4} == {k: x[1:] for k, x in want.items()}
    assert {x for k, x in got.items() if k[1] == 4} == {(1, 1)}
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows])], ["vec_id", "vec", "fact"])
    unit = rerank._units(np.array([rows[0][1], rows[20][1]]), 0)
    shared = SimpleNamespace(value=(np.array([0, 20]), unit, np.zeros(2), np.ones(2), np.full((2, 2), 1), np.zeros((2, 2, 5, 3))))
    for b in rerank._count_ahead(shared, np.array(directions), np.zeros(5), np.ones(5), ALPHAS, 0)(iter([batch])):
        sent.append((b.num_rows, [len(x) for x in b.column(1).to_pylist()]))
    assert sent == [(2, [15, 15])]
    top = {}
    for r in rerank.fused_top(docs, docs.where("vec_id % 20 = 0"), directions, ALPHAS, 4).orderBy("pos").collect():
        top.setdefault((r.q, r.dir, r.alpha10), []).append(r.id)
    assert top == {k: x[0][:4] for k, x in want.items()}


def test_texts_of_answers_are_not_broadcast(spark):
    """Files of like texts are small, the texts are not: whatever Spark reckons, they are joined by a shuffle."""
    from rankloom.plans import endtoend

    top = spark.createDataFrame([(7, 0, 0, 1, 20)], "seed int, alpha10 int, q long, pos int, id long")
    plan = endtoend.answers(spark, "/root/testdata/sf0.001", top, "seed")._jdf.queryExecution().analyzed().toString()
    assert plan.count("ResolvedHint (strategy=merge)") >= 2  # texts and questions


def test_prompts_are_built_and_answered_once(spark, tmp_path, monkeypatch):
    """Answers as of a plain version, for copies, null, empty and missing texts; prompts of one language and the same texts are one, and none is shuffled."""
    import hashlib

    from rankloom.operators import providers
    from rankloom.plans import endtoend

    rows = [(i, f"text {i % 30}" if i % 7 else [None, ""][i % 2], ["de", "en", None][i % 3]) for i in range(100)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = {r[0]: r[1:] for r in rows}
    grid = [(s, a, q) for s in (7, 42) for a in (0, 10) for q in (0, 20, 21, 40, 60, 300)]  # 300 isn't there
    top = [(s, a, q, p + 1, (p * 30 + (q if a == 0 else 0) + p * (s > 7)) % 130) for s, a, q in grid for p in range(5)]
    plans, sent, each = [], [], providers.each

    def spied(df, *rest):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        sent.extend(r.prompt for r in df.collect())
        return each(df, *rest)

    monkeypatch.setattr(providers, "each", spied)
    got = endtoend.answers(spark, str(tmp_path), spark.createDataFrame(top, "seed int, alpha10 int, q long, pos int, id long"), "seed").collect()
    want, prompts = [], set()
    for s, a, q in grid:
        for k in (2, 5) if q in docs else ():
            ids = [x[4] for x in sorted(top) if x[:3] == (s, a, q)][:k]
            text, lang = docs[q]
            made = "Documents:\n" + "\n".join(f"[{n}] {docs.get(i, (None,))[0] or ''}" for n, i in enumerate(ids, 1)) + f"\n\nQuestion: {lang or ''}?\nAnswer:"
            prompts.add(made)
            want.append((s, a, k, None if text is None else hashlib.md5(text.encode()).hexdigest()[0] in "answer " + hashlib.sha256(made.encode()).hexdigest()[:8]))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sorted(sent) == sorted(prompts) and len(prompts) < len(want)
    assert not [line for line in plans[0].splitlines() if "Exchange" in line and "prompt" in line]


def test_first_rows_need_no_pairs_for_moments(spark, monkeypatch):
    """Moments by cross products are those over pairs; flat queries and long vectors take the pass over pairs; a task sends one row a query."""
    rng, over_pairs, asked = np.random.default_rng(23), rerank._moments_and_targets, []

    def spied(docs, shared, directions, tail):
        asked.append(shared.value[0].tolist())
        return over_pairs(docs, shared, directions, tail)

    monkeypatch.setattr(rerank, "_moments_and_targets", spied)
    rows = [(i, [*rng.normal(size=5).tolist(), 0.0], bool(i % 3), "x") for i in range(300)]
    rows += [(300, [0.0] * 5 + [1.0], True, "x"), (320, [0.0] * 5 + [2.0], False, "x"), (None, [1.0] * 6, True, "x")]  # 300 and 320 are far from flat, as they meet each other
    directions, docs = [rng.normal(size=6).tolist() for _ in range(2)], spark.createDataFrame(rows, SCHEMA).repartition(3)

    def firsts(docs):
        got = {}
        for r in rerank.fused_top(docs, docs.where("vec_id % 20 = 0"), directions, ALPHAS, 4).orderBy("pos").collect():
            got.setdefault((r.q, r.dir, r.alpha10), []).append((r.id, r.pos))
        return got

    want = {k: list(zip(x[0], range(1, 5))) for k, x in plain(rows, directions).items()}
    assert firsts(docs) == want and asked == []
    alone = [r for r in rows if r[0] != 320]  # 300 is at right angles to all others
    flat = firsts(spark.createDataFrame(alone, SCHEMA).repartition(3))
    assert asked == [[300]] and {k[2] for k in flat if k[0] == 300} == set() and {k: x for k, x in flat.items() if k[0] != 300} == {k: list(zip(x[0], range(1, 5))) for k, x in plain(alone, directions).items() if k[0] != 300}
    monkeypatch.setattr(rerank, "CROSSED", 5)
    assert firsts(docs) == want and len(asked) == 2
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[:300]]), pa.array([r[1] for r in rows[:300]]), pa.array([r[2] for r in rows[:300]])], ["vec_id", "vec", "fact"])
    shared = SimpleNamespace(value=(np.array([0, 20]), rerank._units(np.array([rows[0][1], rows[20][1]]), 0), np.zeros(2), np.ones(2)))
    assert [(b.num_rows, [len(x) for x in b.column(1).to_pylist()]) for b in rerank._keep_first(shared, np.array(directions), np.zeros(2), np.ones(2), ALPHAS, 4, 0)(iter([batch]))] == [(2, [24, 24])]
