import base64
import hashlib
import io
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from rankloom.llm import warc


def plain(rows):
    """(page_id, html) rows: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    last = {}
    for i, h in rows:
        if i is not None:
            last[h or ""] = max(last.get(h or "", i), i)
    out = []
    for i, h in rows:
        data, top = (h or "").encode(), last.get(h or "")
        first = top is None or i == top
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first else "revisit", None if first else top))
    return out


def key(r):
    return [(x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r]


def test_whole_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = sorted(map(tuple, warc.query(spark, sf).collect()), key=key)
    assert got == sorted(plain([(r.page_id, r.html) for r in pages.collect()]), key=key)
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    assert got == sorted(con.execute(warc.SQL).fetchall(), key=key)


def test_odd_rows(spark):
    rows = [(1, "http://a/\r\nx: y", None), (2, None, ""), (2, "u", ""), (None, "u", "<p>é\r\n\r\nWARC/1.1\r\n"), (7, "u?q=1%20#é", "<p>é\r\n\r\nWARC/1.1\r\n"), (None, "v", "z"), (None, "v", "z"), (9, "w", "long " * 400_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit("x")).withColumn("id", F.lit(5))
    for compress in (True, False):
        files = warc.write(pages, compress=compress)
        found = warc.read(files).collect()
        assert not [r for r in found if r.reason]
        got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found]
        assert sorted(got, key=key) == sorted(plain([(i, h) for i, _, h in rows]), key=key)
        assert {bytes(r.payload) for r in found if r.record_type == "response"} == {(h or "").encode() for _, _, h in rows}
        assert sum(r.records for r in files.collect()) == len(rows)
    assert warc.read(warc.write(pages.limit(0))).collect() == []
    small = warc.read(warc.write(pages, least_bytes=2)).collect()
    assert {r.record_type for r in small if r.payload_bytes < 2} == {"response"}


def damaged(rng, records, compress):
    """A file with damage: (bytes, numbers of the records that are whole)."""
    data, whole = bytearray(), []
    for k, r in enumerate(records):
        raw = warc.member(r) if compress else r
        what = rng.choice(["whole"] * 4 + ["flip", "cut", "junk"])
        if what == "flip":
            raw = bytearray(raw)
            at = rng.randrange(len(raw))
            raw[at] ^= 1 << rng.randrange(8)
        elif what == "cut":
            raw = raw[: rng.randrange(len(raw))]
        elif what == "junk":
            data += rng.randbytes(rng.randrange(50)) + rng.choice([b"", warc.MAGIC, b"WARC/1.1\r\n", b"WARC/1.0\r\nContent-Length: 999999\r\n\r\n"])
        if what in ("whole", "junk"):
            whole.append(k)
        data += raw
    return bytes(data), whole


def test_salvage(monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 97)
    rng = random.Random(6)
    for turn in range(120):
        compress = turn % 2 == 0
        bodies = [rng.randbytes(rng.randrange(300)) + b"WARC/1.1\r\nno record" * (k % 3 == 0) for k in range(8)]
        records = [warc.record(k, "u", p, warc.base32_sha1(p), None) for k, p in enumerate(bodies)]
        data, whole = damaged(rng, records, compress)
        found = list(warc.salvage(io.BytesIO(data).read))
        at = 0
        for x in found:
            assert x.offset == at
            at += x.length
        assert at == len(data)
        got = {warc._page(x.headers["warc-record-id"]): x.payload for x in found if isinstance(x, warc.Record)}
        assert set(whole) <= set(got)
        assert all(bodies[k] == p for k, p in got.items() if k in whole or compress)  # digests do not cover plain headers
        if len(whole) < len(records) and compress:
            assert any(isinstance(x, warc.Gap) for x in found)


def test_damaged_archives_through_read(spark, tmp_path):
    rng = random.Random(8)
    wanted, sizes = {}, {}
    for turn in range(12):
        compress = turn % 2 == 0
        bodies = [rng.randbytes(rng.randrange(300)) for _ in range(30)]
        data, whole = damaged(rng, [warc.record(100 * turn + k, "u", p, warc.base32_sha1(p), None) for k, p in enumerate(bodies)], compress)
        path = tmp_path / f"{turn}.warc{'.gz' if compress else ''}"
        path.write_bytes(data)
        wanted[str(path)], sizes[str(path)] = {100 * turn + k: bodies[k] for k in whole}, len(data)
    files = spark.createDataFrame([(f, 30) for f in wanted], "file string, records long")
    spread = warc.read(files)
    assert spread.rdd.getNumPartitions() == len(wanted)
    rows = spread.collect()
    for f, want in wanted.items():
        mine = sorted((r for r in rows if r.file == f), key=lambda r: r.offset)
        at = 0
        for r in mine:  # several records of one member share its place
            assert r.offset == at and (r.reason is None) == (r.record_type is not None)
            at += r.length
        assert at == sizes[f]
        got = {(r.page_id, bytes(r.payload)) for r in mine if r.reason is None}  # a bit of a plain record's id may be flipped
        assert set(want.items()) <= got
    with pytest.raises(ValueError, match="360 records written"):
        warc.restore(files)


def test_restore_keeps_gaps_beside_records(spark, tmp_path):
    p = b"payload"
    one = warc.member(warc.record(1, "u", p, warc.base32_sha1(p), None))
    (tmp_path / "a.warc.gz").write_bytes(one + b"broken" + one[:20] + warc.member(warc.record(2, "u", p, warc.base32_sha1(p), None)))
    records, gaps = warc.restore(spark.createDataFrame([(str(tmp_path / "a.warc.gz"), 2)], "file string, records long"))
    assert sorted(r.page_id for r in records.collect()) == [1, 2]
    assert [(r.offset, r.length) for r in gaps.collect()] == [(len(one), 26)]


def test_damaged_length_does_not_read_on():
    p = b"x" * 50
    good = warc.record(2, "u", p, warc.base32_sha1(p), None)
    bad = good.replace(b"Content-Length: %d\r\n\r\nHTTP" % (len(good) - good.index(b"HTTP/1.1 200") - 4), b"Content-Length: 999999999999999\r\n\r\nHTTP")
    assert bad != good
    data, most = bad + b"junk " * 2_000_000 + good, 0
    stream = io.BytesIO(data)
    source_more = warc.Source.more

    def more(self):
        nonlocal most
        got = source_more(self)
        most = max(most, len(self.data))
        return got

    warc.Source.more = more
    try:
        found = list(warc.salvage(stream.read, len(data)))
    finally:
        warc.Source.more = source_more
    assert [type(x) for x in found] == [warc.Gap, warc.Record]
    bomb = warc.member(b"WARC/1.1\r\n" + b"a" * 50_000_000)
    old, warc.MOST_BYTES = warc.MOST_BYTES, 1 << 20
    try:
        assert [(type(x), x.reason) for x in warc.salvage(io.BytesIO(bomb).read, len(bomb))] == [(warc.Gap, "member too long")]
    finally:
        warc.MOST_BYTES = old


def slowness():
    import time

    t = time.thread_time()
    sum(range(50_000))
    return max(1.0, (time.thread_time() - t) * 1000)


@pytest.mark.parametrize("line", [b"WARC/1.0\r\n", b"WARC/1.1\r\nno colon\r\n", b"WARC/1.0\r\na: b\r\n"])
def test_version_lines_without_a_header_take_linear_time(line):
    import time

    good = warc.record(7, "u", b"payload", warc.base32_sha1(b"payload"), None)
    data = line * (1_000_000 // len(line)) + good
    began = time.process_time()
    found = list(warc.salvage(io.BytesIO(data).read, len(data)))
    assert time.process_time() - began < 2 * slowness()
    assert [type(x).__name__ for x in found] == ["Gap", "Record"] and found[0].length == len(data) - len(good) and found[1].payload == b"payload"


def test_a_long_gap_is_let_go():
    """200 MB of garbage between two records: one gap that covers every byte, never held whole."""
    import tracemalloc

    good = warc.record(7, "u", b"payload", warc.base32_sha1(b"payload"), None)
    junk = random.Random(3).randbytes(1 << 20).replace(b"\x1f\x8b\x08", b"xxx").replace(b"WARC", b"xxxx")
    parts = iter([good, *[junk] * 200, b"\x1f\x8b", good])
    tracemalloc.start()
    found = list(warc.salvage(lambda n: next(parts, b""), 2 * len(good) + 200 * len(junk) + 2))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(type(x).__name__, x.offset, x.length) for x in found] == [("Record", 0, len(good)), ("Gap", len(good), 200 * len(junk) + 2), ("Record", len(good) + 200 * len(junk) + 2, len(good))]
    assert most < 40 << 20
