import hashlib
import zlib
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from rankloom.llm import prefixtrie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """A dictionary from prefix to members, and sums over all prefixes that begin with another."""
    of = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            of[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))] for c, v in of.items()}
    members = defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        turns = own.get(base, [])[:h] + turns[h:]
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append((c, len(turns)))
    out = []
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children[p]) or 1
        saved[p] = sum(saved[q] for q in children[p]) + (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c, n in m if n == len(p)))
        parent = min(c for c, _ in members[p[:-1]]) if p else None
        out.append((min(c for c, _ in m), len(p), parent, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def built(spark, rows, parts=3, schema="conv_id long, turn long, role string, text string"):
    return sorted(tuple(r) for r in prefixtrie.trie(spark.createDataFrame(rows, schema).repartition(parts)).select(COLUMNS).collect())


def some():
    rows = []
    for c in range(40):
        for t in range(1 + c * 7 % 12):
            rows.append((c * 3 - 20, t, "ua"[t % 2], f"t{t} {c % 4 if t > 2 else 0} {c % 2 if t > 6 else ''}"))
    return rows


def test_against_plain_version(spark):
    assert built(spark, some()) == plain(some())


def test_copies_and_long_ones(spark):
    """Copies by the hundred, and two conversations that differ at turn 700 of 702 only."""
    rows = [(c, t, "user", f"same {t}") for c in range(1000, 1300) for t in range(12)]
    rows += [(c, t, "user", f"long {t}" if t != 700 else f"long {c}") for c in (5000, 5005) for t in range(702)]
    rows += [(7000, t, "r", "x" * t) for t in range(5000)]
    assert built(spark, rows + some(), 7) == plain(rows + some())


def test_odd_rows(spark):
    rows = [(None, 1, "user", "of nobody"), (3, None, None, None), (3, None, "user", ""), (3, 2, "b", "x"), (3, 2, "a", "y"), (3, 2, "a", "y"), (3, 2, "a" * 80, "z"), (3, 2, "a" * 80, "b" * 90), (3, 2, "a" * 64, "c"), (-7, 5, "é", "ß𝔘"), (-5, 1, "u", "base of -7"), (2**62, 1, "u", "far"), (9, 1, "u", "t" * 300_000)]
    rows += [(c, 1, "u", "one turn that the head replaces") for c in range(100, 140)]
    got = built(spark, rows)
    assert got == plain(rows)
    assert any(r[1] == 0 and r[7] != prefixtrie.EMPTY for r in got)  # conversations without a turn end at the root


def test_alone_and_empty(spark):
    assert built(spark, [(4, 1, "u", "a"), (4, 2, "u", "b")]) == plain([(4, 1, "u", "a"), (4, 2, "u", "b")])
    turnless = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0)
    assert built(spark, [(turnless, 1, "u", "a")]) == plain([(turnless, 1, "u", "a")]) == [(turnless, 0, None, 1, 0, 1, 0, hashlib.sha256(str(turnless).encode()).hexdigest())]
    assert built(spark, []) == []


def test_clashing_columns(spark):
    turns = spark.createDataFrame(some(), "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("conv", "pos", "seq", "depth", "w", "base", "h", "part", "at")})
    assert sorted(tuple(r) for r in prefixtrie.trie(turns).select(COLUMNS).collect()) == plain(some())


def test_pieces_of_ids():
    import pyarrow as pa

    n = 2 * prefixtrie.IDS + 5
    batch = pa.RecordBatch.from_pydict({"f1": [1] * n + [2], "f2": [1] * n + [2], "turns": [3] * (n + 1), "conv": [*range(n), 9]})
    pieces = list(prefixtrie._id_pieces(iter([batch])))
    assert len(pieces) == 4
    got = [r for b in prefixtrie._digests(iter(pieces)) for r in b.to_pylist()]
    assert [r["ends"] for r in got] == [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in (range(n), [9])]


def test_twin(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    cursor = con.execute(prefixtrie.SQL)
    at = [[c[0] for c in cursor.description].index(c) for c in COLUMNS]
    want = sorted(tuple(r[k] for k in at) for r in cursor.fetchall())
    assert sorted(tuple(r) for r in prefixtrie.query(spark, sf).select(COLUMNS).collect()) == want and want
