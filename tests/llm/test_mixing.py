import hashlib
import re
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from rankloom.operators import sampling
from rankloom.llm import mixing


def plain(rows):
    """rows of (doc_id, source, text): {(doc_id, size, source_size, target, taken)}."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, _, t in rows]
    total = defaultdict(int)
    for (_, s, _), n in zip(rows, size):
        total[s] += n
    order = sorted((s for s in total if s is not None)) + [None] * (None in total)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_, budget = {}, set(order), 1.5 * sum(total.values())
    while open_:
        share = {s: budget * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * total[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * total[s]
            budget -= target[s]
        open_ -= over
    taken = [0] * len(rows)
    for s in order:
        mine = [k for k, r in enumerate(rows) if r[1] == s]
        times = int(target[s] // total[s]) if total[s] else 0
        rest = target[s] - times * total[s]
        by_hash = lambda k: int(hashlib.md5(f"mix:{'' if rows[k][0] is None else rows[k][0]}".encode()).hexdigest()[:15], 16)
        for k in mine:
            taken[k] = times * size[k]
        at = 0
        for k in sorted(mine, key=by_hash) if rest > 0 else []:
            if at + size[k] > rest:
                if at + size[k] - rest < rest - at:
                    taken[k] += size[k]
                break
            taken[k] += size[k]
            at += size[k]
    return [(r[0], n, total[r[1]], target[r[1]], x) for r, n, x in zip(rows, size, taken)]


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[4])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [(g[0], g[1], g[2], g[4]) for g in got] == [(w[0], w[1], w[2], w[4]) for w in want]
    assert all(abs(g[3] - w[3]) <= 1e-6 * max(1, w[3]) for g, w in zip(got, want))


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = mixing.query(spark, sf).collect()
    same(got, plain(rows))
    assert all(r.taken <= 2 * r.size for r in got)


def test_sql_twin(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.execute(mixing.SQL).fetchall()
    got = mixing.query(spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_odd_rows(spark):
    rows = [(1, "a", None), (1, "a", None), (2, None, "x y z"), (3, None, ""), (None, "b", "one two"), (4, "b", "w " * 9000), (4, "b", "w " * 9000), (5, "\U0001f600", "p q"), (6, "é", "r"), (7, "e", " \t\n")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit("x")).withColumn("key", F.lit(1)).withColumn("h", F.lit(1))
    got = mixing.mix(docs).collect()
    same(got, plain(rows))
    assert mixing.mix(docs.limit(0)).collect() == []
    none = docs.where("text is null")
    assert [(r.target, r.taken) for r in mixing.mix(none).collect()] == [(0.0, 0)] * 2
    kept = mixing.take(docs)
    assert kept.columns == docs.columns
    want = {}
    for r in got:
        if r.size:
            want[r.doc_id] = want.get(r.doc_id, 0) + r.taken // r.size
    have = {r.doc_id: r["count"] for r in kept.groupBy("doc_id").count().collect()}
    assert have == {k: v for k, v in want.items() if v}


def test_rows_of_one_id(spark):
    """Rows that all have one id, or none, are told apart: the source comes within half a row of its target."""
    for ident in (7, None):
        rows = [(ident, "a", "w " * (1 + k % 7)) for k in range(1000)] + [(ident, "b", "w " * 50), (ident, None, "w " * 3)]
        docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
        for got in [mixing.mix(docs).collect()]:
            of = defaultdict(list)
            for r in got:
                of[r.source_size].append(r)
                assert r.taken % r.size == 0 and r.taken // r.size in (int(r.target // r.source_size), int(r.target // r.source_size) + 1) and r.taken <= 2 * r.size
            assert sorted(map(len, of.values())) == [1, 1, 1000]
            a = max(of.values(), key=len)
            assert abs(sum(r.taken for r in a) - a[0].target) <= 3.5
        if ident is None:
            continue
        assert abs(mixing.take(docs).where("source = 'a'").selectExpr("sum(size(split(trim(text), ' ')))").first()[0] - a[0].target) <= 3.5


def test_clashing_names(spark):
    docs = spark.createDataFrame([(k, "ab"[k % 2], "w " * (k + 1), k) for k in range(50)], "doc_id long, source string, text string, __mix_key int")
    for c in ("_x0", "_X1", "_x3", "key", "row", "threshold", "rest"):
        docs = docs.withColumn(c, F.lit(c))
    kept = mixing.take(docs)
    assert kept.columns == docs.columns and all(r["_x0"] == "_x0" and r["row"] == "row" and r["__mix_key"] == r.doc_id for r in kept.collect())
    assert kept.groupBy("doc_id").count().join(mixing.mix(docs).selectExpr("doc_id", "taken / size as n"), "doc_id").where("count <> n").isEmpty()


def test_no_python_on_the_executors(spark, monkeypatch):
    """Sources are ranked by DataFrame functions, however many partitions they lie in."""
    docs = spark.createDataFrame([(k, f"s{k % 37}" if k % 41 else None, "a b c") for k in range(400)], "doc_id long, source string, text string").repartition(5)

    def fails(*_):
        raise AssertionError("Python on the executors")

    monkeypatch.setattr(type(docs), "mapInArrow", fails)
    assert mixing.mix(docs).count() == 400 and mixing.take(docs).count() > 0
    keys = spark.createDataFrame([(f"k{x % 301:03d}" if x else None,) for x in range(900)], "key string").repartition(7)
    got = sorted((r.place, r.key) for r in sampling.dense_ids(keys, "key", "place").collect())
    assert got == list(enumerate([None, *(f"k{x:03d}" for x in range(301))]))
