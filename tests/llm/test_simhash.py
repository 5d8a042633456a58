import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from rankloom.llm import simhash


def plain_fingerprint(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)})
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(fps, t=3):
    ids = sorted(fps)
    label = {i: i for i in ids}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    arr = np.array([fps[i] for i in ids], np.uint64)
    for a, i in enumerate(ids):
        for b in np.flatnonzero(np.bitwise_count(arr[a + 1 :] ^ arr[a]) <= t):
            x, y = sorted((root(i), root(ids[a + 1 + b])))
            label[y] = x
    return {i: root(i) for i in ids}


def test_codes_are_perfect():
    leader, ends, _ = simhash._patterns(simhash.GOLAY_POLY, 23, 3)
    assert len(leader) == 2048 and np.count_nonzero(leader) == 2047
    assert np.bitwise_count(leader).max() == 3
    leader, _, _ = simhash._patterns(simhash.HAMMING_POLY, 7, 1)
    assert len(leader) == 8 and np.bitwise_count(leader).max() == 1


def test_neighbours_always_meet():
    rng = random.Random(1)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for k in rng.sample(range(64), rng.randint(0, 3)):
            y ^= 1 << k
        row, key, home = simhash.anchors(np.array([x, y], np.uint64))
        homes_of_x = set(key[(row == 0) & home].tolist())
        assert homes_of_x & set(key[row == 1].tolist())


def test_whole_table_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = plain_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.query(spark, sf).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in texts}
    assert len(set(want.values())) < len(want)


def test_dense_and_hot_anchors(spark, monkeypatch):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(4)]
    fps = {}
    for i in range(1500):
        x = base[rng.randrange(4)]
        for k in rng.sample(range(64), rng.randint(0, 6)):
            x ^= 1 << k
        fps[i] = x
    want = plain_components(fps)
    monkeypatch.setattr(simhash, "HOME_BLOCK", 5)
    signed = [(i, int(np.uint64(x).view(np.int64))) for i, x in fps.items()]
    edges = simhash.links(spark.createDataFrame(signed, "id long, fp long").select("fp").distinct())
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    groups = {}
    for i, x in signed:
        groups.setdefault(roots.get(x, x), set()).add(i)
    plain = {}
    for i, r in want.items():
        plain.setdefault(r, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, plain.values()))


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "a b c d"), (3, "A b\tc d"), (4, "word " * 5000), (5, "\x00 \x1c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("x")).withColumn("id", F.lit(7)).withColumn("root", F.lit(1))
    got = sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str)
    assert len(got) == len(rows)
    by = {r[0]: r for r in got}
    assert by[1][1] == by[2][1] == "0" * 16 and by[1][2] == by[2][2] == 1
    assert by[None][1:] == (by[3][1], 3)
    assert by[5][1] == f"{plain_fingerprint(chr(0) + ' ' + chr(28)):016x}"
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_keep_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    want = {r.component_id for r in simhash.near_duplicates(docs).collect()}
    got = [r.doc_id for r in kept.collect()]
    assert len(got) == len(want) and set(got) == want
    odd = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (1, "x y z w"), (None, "q r s"), (None, "q r s"), (0, None)], "doc_id long, text string").withColumn("fp", F.lit(1))
    assert sorted(r.text or "" for r in simhash.keep_one(odd).collect()) == ["", "a b c", "q r s", "x y z w"]


def test_groups_over_several_batches():
    """Homes that are carried over a batch's end meet what follows, and not each other again."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 3).astype(np.uint64)
    fp = np.array([base[k % 3] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, k % 4).astype(np.uint64), initial=np.uint64(0)) for k in range(200)], np.uint64)
    fp = np.unique(fp)
    home = np.arange(len(fp)) < 60
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(fp), np.int64)), pa.array(np.zeros(len(fp), np.int32)), pa.array(home), pa.array(fp.view(np.int64))], ["anchor", "block", "home", "fp"])

    def joined(batches):
        label = {int(x): int(x) for x in fp.view(np.int64)}

        def root(x):
            while label[x] != x:
                x = label[x]
            return x

        for b in simhash._compare(iter(batches)):
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                label[max(root(u), root(v))] = min(root(u), root(v))
        return [root(int(x)) for x in fp.view(np.int64)]

    met = {(i, j) for i in range(len(fp)) for j in range(i) if (home[i] or home[j]) and bin(int(fp[i] ^ fp[j])).count("1") <= 3}
    want = list(range(len(fp)))
    for _ in want:
        for i, j in met:
            want[i] = want[j] = min(want[i], want[j])
    groups = lambda label: sorted(sorted(k for k, x in enumerate(label) if x == r) for r in set(label))
    for size in (7, 40, 1000):
        assert groups(joined([batch.slice(k, size) for k in range(0, len(fp), size)])) == groups(want)


def test_keep_one_keeps_clashing_columns(spark):
    rows = [(1, "a b c"), (2, "a b c"), (3, None), (4, "x y z w")]
    for extra in ([], [(4, "x y z w")]):
        docs = spark.createDataFrame(rows + extra, "doc_id long, text string")
        for c in ("__fp", "__id", "__none", "_x0", "_X1", "id", "fp"):
            docs = docs.withColumn(c, F.lit(c))
        kept = simhash.keep_one(docs)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]
        assert all(r["__fp"] == "__fp" and r["_x0"] == "_x0" and r["id"] == "id" for r in kept.collect())
