"""Language identification: multinomial logistic regression on TF-IDF character n-grams, trained with FTRL.

Features are hashed character 1- to 3-grams of the lower-cased letters of the whole text, every run of other characters
counting as one space, weighted (1 + log tf) * idf and scaled to length 1. Document frequencies are counted over all
training rows. The classifier is fitted on a bounded sample of distinct texts: at most PER_LANG of each language, those with the least
hash, and at most MOST_ROWS in all, but one of each language, by follow-the-regularised-leader with elastic-net penalties (the L1 part
keeps the weights sparse). A fifth of each language's sample, from five texts on, is held back from the fit to set the temperature by which
the scores are divided. Languages with fewer texts are gone through more often. The driver holds the sample and the weights (2^15 x languages),
nothing that grows with the corpus.

Defined results: a text without a letter, null or empty ones among them, is `und` with score 0; rows with a null language
teach nothing; copies of a text count in the frequencies and are fitted once; without any training row everything is `und`; a null id counts
as an empty one in the fold rule; repeated rows stay repeated; columns other than the named ones are not looked at.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship
from . import common

BITS = 15
DIM = 1 << BITS
ORDERS = (1, 2, 3)
#: Distinct texts of each language, and of all together, that the classifier is fitted on at most.
PER_LANG, MOST_ROWS = 400, 20_000
EPOCHS = 3
#: FTRL: learning rate, its smoothing, and the two penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 2e-3, 1e-4
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, counts) of a text; empty if it has no letter."""
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[code]
    if not letter.any():
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    code = np.where(letter, code, 32)
    keep = letter | np.concatenate(([False], letter[:-1]))  # after a letter the first of a run of other characters stays
    code = np.concatenate(([32], code[keep])).astype(np.uint32)
    if code[-1] != 32:
        code = np.append(code, np.uint32(32))
    hashed, h = [], np.zeros(len(code), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        h = h[: len(code) - n + 1] * np.uint32(0x01000193) + code[n - 1 :] * np.uint32(0x9E3779B1) + np.uint32(n)
        if n in ORDERS:
            hashed.append((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS))
    tf = np.bincount(np.concatenate(hashed), minlength=DIM)
    at = np.flatnonzero(tf)
    return at.astype(np.int32), tf[at].astype(np.int32)


def _df_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(DIM + 1, np.int64), 0
    for b in batches:
        for t in b.column(0):
            df[grams(t.as_py())[0]] += 1
            n += 1
    df[DIM] = n  # the number of rows, as one more feature
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], ["feature", "df"])


def _gram_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [grams(t.as_py()) for t in b.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.list_(pa.int32())), pa.array([x for _, x in found], pa.list_(pa.int32())), b.column(1), b.column(2)], ["at", "tf", "lang", "h"])


class Model:
    """Languages, idf, weights (features x languages), biases and temperature."""

    def __init__(self, langs: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float = 1.0):
        self.langs, self.idf, self.weights, self.bias, self.temperature = langs, idf, weights, bias, temperature

    def vector(self, at: np.ndarray, tf: np.ndarray) -> np.ndarray:
        x = (1 + np.log(tf)) * self.idf[at]
        return x / (np.linalg.norm(x) or 1.0)

    def scores(self, at: np.ndarray, tf: np.ndarray) -> np.ndarray:
        return self.vector(at, tf) @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        at, tf = grams(text)
        if not len(at) or not self.langs:
            return UNKNOWN, 0.0
        p = _softmax(self.scores(at, tf) / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_classes: int, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases from rows of (features, values, class), each step of one row."""
    z, n = np.zeros((DIM + 1, n_classes)), np.zeros((DIM + 1, n_classes))

    def weights(at):
        zz = z[at]
        return np.where(np.abs(zz) <= L1, 0.0, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    order = np.random.default_rng(0)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at, x, y = rows[k]
            at, x = np.append(at, DIM), np.append(x, 1.0)
            w = weights(at)
            p = _softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(DIM + 1))
    return w[:DIM], w[DIM]


def temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the scores with the least log loss, by golden section over its logarithm."""
    if not len(y):
        return 1.0
    loss = lambda t: -np.mean(np.log(_softmax(scores / math.exp(t))[np.arange(len(y)), y] + 1e-300))
    a, b, g = math.log(0.02), math.log(20), (math.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return math.exp((a + b) / 2)


def fold(ident: Column) -> Column:
    """crc32 of the id as text, modulo 4; fold 2 is held out."""
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % 4


def train(rows: DataFrame, per_lang: int = PER_LANG) -> Model:
    """A model from rows of (text, lang)."""
    ship(rows.sparkSession)
    rows = rows.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    counts = rows.select("text").mapInArrow(_df_batches, "feature int, df long").groupBy("feature").agg(F.sum("df").alias("df"))
    df = np.zeros(DIM + 1)
    for r in counts.collect():  # at most one row for each feature
        df[r["feature"]] = r["df"]
    idf = np.log((1 + df[DIM]) / (1 + df[:DIM])) + 1
    hashed = rows.withColumn("h", F.md5(F.concat(F.lit("lang:"), F.col("text"))))
    of_lang = hashed.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"))
    per_lang = max(1, min(per_lang, MOST_ROWS // max(1, of_lang.count())))
    # some more than are needed pass by their hash, which copies of a text share; what passes is reduced to one of each and counted off
    share = hashed.join(F.broadcast(of_lang), "lang").where(F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / float(1 << 32) <= F.lit(2.0 * per_lang + 50) / F.col("n"))  # one row a language, as the model's weights
    least = share.select("text", "lang", "h").dropDuplicates(["lang", "h"]).withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= per_lang)
    found = least.select("text", "lang", "h").mapInArrow(_gram_batches, "at array<int>, tf array<int>, lang string, h string").toArrow()  # at most MOST_ROWS, or one a language
    at, tf = (found.column(c).combine_chunks() for c in ("at", "tf"))
    keys = sorted((lang, h, k) for k, (lang, h) in enumerate(zip(found.column("lang").to_pylist(), found.column("h").to_pylist())))
    found = [(lang, at[k].values.to_numpy(), tf[k].values.to_numpy()) for lang, h, k in keys if len(at[k])]
    langs = sorted({r[0] for r in found})
    model = Model(langs, idf, np.zeros((DIM, len(langs))), np.zeros(len(langs)))
    parts, back = [], []
    for y, lang in enumerate(langs):
        mine = [(at, model.vector(at, tf), y) for of, at, tf in found if of == lang]
        parts.append([r for k, r in enumerate(mine) if k % 5 != 4])
        back += mine[4::5]
    most = max(map(len, parts), default=0)
    fit = [r for mine in parts for r in mine * (most // len(mine))]
    if fit:
        model.weights, model.bias = ftrl(fit, len(langs))
        model.temperature = temperature(np.array([x @ model.weights[at] + model.bias for at, x, _ in back]), np.array([y for *_, y in back], int))
    return model


def _predictor(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            found = [model.predict(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs; learns from its rows outside the held-out fold unless given a model."""
    ship(docs.sparkSession)
    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"), (fold(docs[id_col]) == 2).alias("held_out"))
    model = model or train(picked.where("not held_out").select("text", "lang"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return picked.select("doc_id", "text", "held_out").mapInArrow(_predictor(shared), "doc_id long, held_out boolean, lang_pred string, score double")


#: A document whose best language has less than this probability is rejected, as is one without a letter.
LEAST_SCORE = 0.35


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = LEAST_SCORE) -> DataFrame:
    """docs without those whose language is not identified."""
    ship(docs.sparkSession)
    picked = docs.select(docs[text_col].alias("text"), docs[lang_col].alias("lang"), (fold(docs[id_col]) == 2).alias("held_out"))
    shared = docs.sparkSession.sparkContext.broadcast(train(picked.where("not held_out").select("text", "lang")))
    at = docs.columns.index(text_col)

    def run(batches):
        model = shared.value
        for b in batches:
            found = [model.predict(t.as_py()) for t in b.column(at)]
            yield b.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(common.table(spark, sf_dir, "documents"))
