"""The offset index against reading the bytes, with blank, torn and long lines over many splits."""

import json
import os
import random

import pytest

from rankloom.sources import offsets, store


@pytest.fixture(scope="module")
def shards(tmp_path_factory):
    rng, folder = random.Random(4), tmp_path_factory.mktemp("shards with space")
    n = 0
    for k in range(7):
        lines = []
        for _ in range(rng.randrange(1, 120)):
            kind = rng.random()
            text = rng.choice("aéß𝔘\t") * rng.randrange(0, 90)
            lines.append("" if kind < 0.1 else '{"id": 5, "text": "to' if kind < 0.15 else "null" if kind < 0.2 else json.dumps({"text": text}) if kind < 0.25 else json.dumps({"id": n, "text": text}, ensure_ascii=bool(k % 2)) + ("\r" if k == 3 else ""))
            n += 1
        data = "\n".join(lines).encode() + (b"\n" if k % 3 else b"")
        (folder / f"part-{k}.json").write_bytes(data)
    (folder / "empty.json").write_bytes(b"")
    return str(folder)


@pytest.mark.parametrize("split", ["97", "1000000"])
def test_entries_are_the_lines(spark, shards, split):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = {(os.path.basename(r.file), r.offset): (r.length, r.key) for r in offsets.build(spark, shards, "id").collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = {}
    for name in os.listdir(shards):
        at = 0
        for line in open(os.path.join(shards, name), "rb").read().split(b"\n"):
            if line:
                try:
                    key = json.loads(line)
                    key = str(key["id"]) if isinstance(key, dict) and "id" in key else None
                except ValueError:
                    key = "torn"
                want[name, at] = (len(line), key)
            at += len(line) + 1
    assert set(got) == set(want)
    assert all(got[k][0] == want[k][0] and (got[k][1] == want[k][1] or want[k][1] == "torn") for k in want)


def test_fetch(spark, shards):
    index = offsets.build(spark, shards, "id")
    rows = offsets.fetch(index.where("key is not null"), "id long, text string").collect()
    assert len(rows) == index.where("key is not null").count() > 100
    whole = {}
    for name in os.listdir(shards):
        for line in open(os.path.join(shards, name), encoding="utf-8", newline="\n").read().split("\n"):
            try:
                record = json.loads(line)
                whole[record["id"]] = record["text"]
            except (ValueError, TypeError, KeyError):
                pass
    good = [r for r in rows if r.record and r.record.id is not None and r.line.rstrip("\r").endswith("}")]
    assert len(good) >= len(whole) and all(r.record.text == whole[r.record.id] and str(r.record.id) == r.key for r in good)


def test_few_bytes_are_read(spark, tmp_path):
    """Twenty records of many shards: what is fetched is under a hundredth of the bytes."""
    df = spark.range(20_000).selectExpr("id", "repeat(md5(cast(id as string)), 3) as text").repartition(40)
    path = str(tmp_path / "many")
    store.write_jsonl(df, path)
    index = offsets.build(spark, path, "id")
    picked = offsets.fetch(offsets.sample(index, 20, 42), "id long, text string").collect()
    size = sum(os.path.getsize(os.path.join(path, f)) for f in os.listdir(path) if f.startswith("part-"))
    assert len(picked) == 20 and sum(r.length for r in picked) < size / 100
    import hashlib

    order = sorted(range(20_000), key=lambda k: hashlib.md5(f"42:{k}".encode()).hexdigest())[:20]
    assert {r.record.id for r in picked} == set(order)


def test_empty(spark, tmp_path):
    (tmp_path / "none.json").write_bytes(b"\n\n")
    index = offsets.build(spark, str(tmp_path), "id")
    assert index.collect() == [] and offsets.fetch(index, "id long").collect() == []
