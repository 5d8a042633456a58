import hashlib
import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from rankloom.llm import langid


def test_grams_against_plain():
    def plain(text):
        text = "".join(c if c.isalpha() else " " for c in text.lower())
        text = " " + " ".join(text.split()) + " "
        return {n: {text[i : i + n] for i in range(len(text) - n + 1)} for n in (1, 2, 3)}

    for t in ["abc", "  ab, cd!", "É1é--ñ\n", "x" * 50]:
        at, tf = langid.grams(t)
        want = plain(t)
        assert tf.sum() == sum(max(0, len(" " + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) + " ") - n + 1) for n in (1, 2, 3))
        assert len(at) <= sum(map(len, want.values()))
    for t in [None, "", "12 !?", "\n"]:
        assert len(langid.grams(t)[0]) == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = langid.identify(docs).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    out = [r for r in rows if r.held_out]
    hits = [r.lang_pred == truth[r.doc_id] for r in out]
    assert len(out) > 150 and np.mean(hits) >= 0.97
    assert abs(np.mean([r.score for r in out]) - np.mean(hits)) < 0.06  # calibrated
    assert all(0 <= r.score <= 1 for r in rows)


def test_temperature_and_sparsity():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 3, 4000)
    s = rng.normal(size=(4000, 3))
    s[np.arange(4000), y] += 1.5
    assert abs(langid.temperature(s * 4, y) / langid.temperature(s, y) - 4) < 0.1
    rows = [(np.array([0, 5 + k % 7]), np.array([1.0, 0.2]), 0) if k % 2 else (np.array([1, 5 + k % 7]), np.array([1.0, 0.2]), 1) for k in range(200)]
    w, _ = langid.ftrl(rows, 2)
    assert w[0, 0] > w[0, 1] and w[1, 1] > w[1, 0] and np.count_nonzero(w[20:]) == 0


def plain_features(text):
    """Counts of character 1- to 3-grams by feature number."""
    text = "".join(c if c.isalpha() else " " for c in text.lower())
    text = " " + " ".join(text.split()) + " "
    out = {}
    for n in (1, 2, 3):
        for i in range(len(text) - n + 1):
            h = 0
            for k in range(1, n + 1):  # each order hashes on from the one before it
                h = (h * 0x01000193 + ord(text[i + k - 1]) * 0x9E3779B1 + k) % 2**32
            f = (h * 0x85EBCA6B) % 2**32 >> (32 - langid.BITS)
            out[f] = out.get(f, 0) + 1
    return out


def plain_ftrl(rows, n_classes):
    z, n = {}, {}

    def w(i, c):
        zz, nn = z.get((i, c), 0.0), n.get((i, c), 0.0)
        return 0.0 if abs(zz) <= langid.L1 else -(zz - math.copysign(langid.L1, zz)) / ((langid.BETA + math.sqrt(nn)) / langid.ALPHA + langid.L2)

    order = np.random.default_rng(0)
    for _ in range(langid.EPOCHS):
        for k in order.permutation(len(rows)):
            x, y = rows[k]
            x = {**x, langid.DIM: 1.0}
            s = [sum(v * w(i, c) for i, v in x.items()) for c in range(n_classes)]
            e = [math.exp(v - max(s)) for v in s]
            for c in range(n_classes):
                err = e[c] / sum(e) - (c == y)
                for i, v in x.items():
                    g, old = err * v, n.get((i, c), 0.0)
                    z[i, c] = z.get((i, c), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / langid.ALPHA * w(i, c)
                    n[i, c] = old + g * g
    return w


def test_against_plain_version(spark):
    """Features, frequencies, weights and predictions of a small corpus against loops over dictionaries."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 700").collect()
    rows = [(r.doc_id, r.text, r.lang) for r in docs if any(c.isalpha() for c in r.text)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    learn = [(t, lang) for i, t, lang in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    df = {}
    for t, _ in learn:
        for f in plain_features(t):
            df[f] = df.get(f, 0) + 1

    def vector(t):
        x = {f: (1 + math.log(c)) * (math.log((1 + len(learn)) / (1 + df.get(f, 0))) + 1) for f, c in plain_features(t).items()}
        size = math.sqrt(sum(v * v for v in x.values()))
        return {f: v / size for f, v in x.items()}

    key = lambda t: hashlib.md5(f"lang:{t}".encode()).hexdigest()
    langs = sorted({lang for _, lang in learn})
    parts, back = [], []
    for y, lang in enumerate(langs):
        mine = sorted({key(t): t for t, of in learn if of == lang}.items())[: langid.PER_LANG]
        parts.append([(vector(t), y) for k, (_, t) in enumerate(mine) if k % 5 != 4])
        back += [(vector(t), y) for k, (_, t) in enumerate(mine) if k % 5 == 4]
    fit = [r for mine in parts for r in mine * (max(map(len, parts)) // len(mine))]
    w = plain_ftrl(fit, len(langs))
    score = lambda x: [sum(v * w(f, c) for f, v in x.items()) + w(langid.DIM, c) for c in range(len(langs))]
    temper = langid.temperature(np.array([score(x) for x, _ in back]), np.array([y for _, y in back]))
    for i, t, _ in rows:
        s = np.array(score(vector(t))) / temper
        p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
        assert got[i].lang_pred == langs[int(p.argmax())] and abs(got[i].score - p.max()) < 1e-6


def test_no_language_is_lost(spark):
    """A language of copies of one text, one of a single text, and ordinary ones."""
    rows = [(k, "le chat est la " * 3, "aa") for k in range(6000)] + [(10000 + k, f"the dog and this {'qx'[k % 2]} house {k}", "bb") for k in range(300)] + [(20000, "zuvo wexi", "cc"), (20001, "zuvo wexi", "cc"), (20003, "zuvo wexi", "cc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert any(not h for (h,) in docs.where("lang = 'cc'").select(langid.fold(F.col("doc_id")) == 2).collect())
    wrong = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("lang <> lang_pred").count()
    assert wrong == 0


def test_odd_rows(spark):
    rows = [(k, ("le chat est la " if k % 2 else "the dog and this ") * 4, "fr" if k % 2 else "en") for k in range(60)] + [(100, None, "fr"), (101, "", None), (102, "12 34", "xx"), (None, "the dog", None), (103, "chat la est " * 20000, "fr"), (103, "chat", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("held_out", F.lit(1)).withColumn("score", F.lit("x"))
    got = langid.identify(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (100, 101, 102))
    assert by[None].lang_pred == "en" and by[103].lang_pred == "fr" and all(by[k].lang_pred == ("fr" if k % 2 else "en") for k in range(60))
    assert langid.identify(docs.limit(0)).collect() == []
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
