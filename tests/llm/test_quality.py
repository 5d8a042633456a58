import hashlib
import math
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from rankloom.llm import quality


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    inside = {k for at in windows.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside), failed


ODD = [None, "", "a " * 8, "a " * 9, "a b c d e f g h " * 2, "x\ny\nx\n\n \n \nx", "\x1c\x85\xa0 é#*|", "one two three four five six seven eight nine " * 2000, "w1 w2 w3 w4 w5 w6 w7 w8 z w1 w2 w3 w4 w5 w6 w7 w8", " \t\n\x0b\x0c\r"]


def check(rows, texts):
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(texts[r.doc_id]), r.doc_id
        assert not (r.base_failed and r.kept) and 0 <= r.score <= 1


def test_counts_whole_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = quality.query(spark, sf).collect()
    assert len(rows) == len(texts)
    check(rows, texts)


def test_windows():
    rng = np.random.default_rng(4)
    for _ in range(300):
        words = [str(x) for x in rng.integers(0, 2 + rng.integers(0, 3), rng.integers(0, 40))]
        assert quality.repeated_words(words) == plain(" ".join(words))[4]


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = quality.train(docs, labels.where(fold != 2))
    truth = {r.doc_id: r.quality for r in labels.where(fold == 2).collect()}
    rows = [r for r in quality.judge(docs.where(fold == 2), model).collect() if r.doc_id in truth]
    good = [r for r in rows if truth[r.doc_id] == 1 and not r.base_failed]
    bad = [r for r in rows if truth[r.doc_id] == 0]
    print("kept of good", np.mean([r.kept for r in good]), "kept of bad", np.mean([r.kept for r in bad]), len(good), len(bad))
    assert np.mean([r.kept for r in good]) >= 0.97 and np.mean([r.kept for r in bad]) <= 0.1
    p, y = np.array([r.score for r in rows if not r.base_failed]), np.array([truth[r.doc_id] for r in rows if not r.base_failed])
    assert np.mean((p - y) ** 2) < 0.05


def test_odd_rows(spark):
    docs = spark.createDataFrame(list(enumerate(ODD)) + [(3, "a " * 9), (None, "q " * 30)], "doc_id long, text string").withColumn("label", F.lit(1)).withColumn("h", F.lit("x"))
    labels = spark.createDataFrame([(0, 0, None), (4, 1, 1), (4, 0, 0), (None, 1, 1), (7, None, 1), (8, 1, 0)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))
    model = quality.train(docs, labels)
    rows = quality.judge(docs, model).collect()
    assert len(rows) == len(ODD) + 2
    check([r for r in rows if r.doc_id is not None], dict(enumerate(ODD)))
    none = quality.train(docs, labels.limit(0))
    assert all(r.kept == (not r.base_failed) for r in quality.judge(docs, none).collect())
    assert quality.judge(docs.limit(0), none).collect() == []
    assert quality.train(docs.limit(0), labels).weights is None


def plain_features(text):
    """{(kind, hashed feature): value} of the n-grams and shares of a text, by loops."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n_words, chars, symbols, dup, repeat, _ = plain(text)
    top = 32 - quality.BITS
    grams, ones, twos = {}, {}, {}
    for a, b, c in zip(text, text[1:], text[2:]):
        h = (((ord(a) * 0x9E3779B1 + ord(b) * 0x85EBCA6B + ord(c) * 0xC2B2AE35) % 2**32) * 0x27D4EB2F % 2**32) >> top
        grams[h] = grams.get(h, 0) + 1
    crc = lambda w: zlib.crc32(w.encode())
    seen = {w: words.count(w) for w in set(words)}
    out = [(h, 1 + math.log(c)) for h, c in grams.items()]
    parts = [out, [(crc(w) * 0x9E3779B1 % 2**32 >> top, 1 + math.log(c)) for w, c in seen.items()], [(h * 0x85EBCA77 % 2**32 >> top, 1.0) for h in {crc(a) * 0x01000193 % 2**32 ^ crc(b) for a, b in zip(words, words[1:])}]]
    x = {}
    for kind, part in enumerate(parts):
        size = math.sqrt(sum(v * v for _, v in part)) or 1.0
        for h, v in part:
            x[kind, h] = x.get((kind, h), 0.0) + v / size
    upper = sum(w.isupper() and len(w) > 1 for w in seen) / max(1, len(seen))
    n = max(1, n_words)
    for k, v in enumerate((1.0, symbols / max(1, chars), repeat / n, 1 - len(seen) / n, upper, min(1.0, dup / (text.count("\n") + 1)))):
        x[3, k] = v
    return x


def test_verdict_against_plain_version(spark):
    """Sample, weights, calibration and verdicts of a small table against loops over dictionaries."""
    some = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars < 500").collect()[:160]
    docs, labels = [(r.doc_id, r.text) for r in some], [(r.doc_id, int(r.lang in ("en", "de"))) for r in some]  # any label that can be learned will do
    made = quality.train(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"))
    text, rows = dict(docs), sorted((hashlib.md5(f"quality:{i}".encode()).hexdigest(), y, i) for i, y in labels)
    data = [({k: float(np.float32(v)) for k, v in plain_features(text[i]).items()}, y) for _, y, i in rows]
    ahead, back = [r for k, r in enumerate(data) if k % 5], [r for k, r in enumerate(data) if not k % 5]
    w, g2 = {}, {}
    good = sum(y for _, y in ahead)
    weight = {1: len(ahead) / (2 * good), 0: len(ahead) / (2 * (len(ahead) - good))}
    order = np.random.default_rng(0)
    for _ in range(quality.EPOCHS):
        for k in order.permutation(len(ahead)):
            x, y = ahead[k]
            err = (1 / (1 + math.exp(-sum(v * w.get(f, 0.0) for f, v in x.items()))) - y) * weight[y]
            for f, v in x.items():
                g = err * v + quality.L2 * w.get(f, 0.0)
                g2[f] = g2.get(f, 1e-8) + g * g
                w[f] = w.get(f, 0.0) - quality.RATE * g / math.sqrt(g2[f])
    s = np.array([sum(v * w.get(f, 0.0) for f, v in x.items()) for x, _ in back])
    y = np.array([y for _, y in back])
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    loss = lambda a, b: -np.sum(target * -np.log1p(np.exp(-(a * s + b))) + (1 - target) * -np.log1p(np.exp(a * s + b)))
    assert all(loss(made.slope, made.shift) <= loss(made.slope + da, made.shift + db) + 1e-9 for da in (-0.01, 0, 0.01) for db in (-0.01, 0, 0.01))
    some = spark.createDataFrame(docs, "doc_id long, text string")
    for r in quality.judge(some, made).collect():
        p = 1 / (1 + math.exp(-(made.slope * sum(v * w.get(f, 0.0) for f, v in plain_features(text[r.doc_id]).items()) + made.shift)))
        assert r.base_failed or (abs(r.score - p) < 1e-3 and (abs(p - 0.5) < 1e-3 or r.kept == (p >= 0.5)))


def test_repeated_ids_do_not_reach_the_driver(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    seen, real = [], DataFrame.toArrow
    monkeypatch.setattr(DataFrame, "toArrow", lambda df: seen.append(real(df)) or seen[-1])
    docs = spark.range(20000).selectExpr("1L as doc_id", "concat('some text ', id) as text").union(spark.createDataFrame([(k, f"other text {k}") for k in range(2, 30)], "doc_id long, text string"))
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 30)], "doc_id long, quality int")
    quality.train(docs, labels, per_label=10)
    assert [t.num_rows <= 20 for t in seen] == [True]
