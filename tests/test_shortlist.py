"""Shortlists from the pruned index against scoring all pairs; the way from pages to answers."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rankloom.operators import shortlist as sl


def corpus(n=600, seed=0):
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 400}"
    docs = [(k // 7, k % 7, [word() for _ in range(rng.randrange(0, 30))]) for k in range(n)]
    asked = [(q, t, rng.randrange(1, 50)) for q in range(12) for t in sorted({word() for _ in range(rng.randrange(1, 25))})]
    return docs, asked


def plain(docs, asked, m):
    of = defaultdict(dict)
    for q, t, w in asked:
        of[q]
        if t is not None:
            of[q][t] = w
    out = {}
    for q, weights in of.items():
        scored = sorted(((-sum(weights.get(t, 0) for t in set(terms)), page, chunk) for page, chunk, terms in docs))[:m]
        out[q] = [(page, chunk, -s) for s, page, chunk in scored]
    return out


def listed(spark, docs, asked, m, block=4):
    df = spark.createDataFrame(docs, "page long, chunk long, terms array<string>").repartition(3)
    found = sl.shortlist(df, ["page", "chunk"], F.struct("page", F.floor(F.col("chunk") / block)), F.col("terms"), spark.createDataFrame(asked, "q long, term string, weight long"), m)
    out = defaultdict(list)
    for r in sorted(found.top.collect(), key=lambda r: (r.q, r.pos)):
        out[r.q].append((r.page, r.chunk, r.score))
    return dict(out), found


@pytest.mark.parametrize("m", [1, 5, 40])
def test_equal_to_all_pairs(spark, m):
    docs, asked = corpus()
    got, _ = listed(spark, docs, asked, m)
    assert got == plain(docs, asked, m)


def test_odd_queries(spark):
    """One without terms, one whose terms nobody has, one of two documents, ties everywhere, null terms."""
    docs = [(k, 0, ["a", "b", "a"] if k % 2 else ["a", None]) for k in range(30)] + [(99, 0, ["rare"]), (98, 3, []), (97, 0, None)]
    asked = [(1, None, 1), (2, "absent", 3), (3, "rare", 2), (4, "a", 1), (4, "b", 1), (5, "rare", 1), (5, "a", 100)]
    got, _ = listed(spark, docs, asked, 4)
    assert got == plain([(p, c, t or []) for p, c, t in docs], asked, 4)
    assert listed(spark, [], asked, 4)[0] == {} and listed(spark, docs, [], 4)[0] == {}


def test_few_are_scored(spark):
    """Under a tenth of all pairs of questions and chunks is scored, and no plan has a nested loop over chunks."""
    from rankloom.plans import web

    d = "/root/testdata/sf0.01"
    found = web.recalled(spark, d, 5)
    asked, chunks = web.questions(spark, d).count(), web.chunks(spark, d).count()
    assert found.scored.count() < 0.1 * asked * chunks
    assert "CartesianProduct" not in found.top._jdf.queryExecution().toString()
