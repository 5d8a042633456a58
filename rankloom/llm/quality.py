"""Quality rules: fixed heuristics, and logistic regression on hashed word and character n-grams.

The heuristics are counts over the whole text; two of them reject on their own. Everything else is left to a classifier trained
on labelled rows: hashed word 1- and 2-grams and character 3-grams of the whole text (letters by class where it matters:
case, digits and symbols are kept), counts damped and scaled, plus a few of the counts as shares. It is fitted on a bounded sample
(at most PER_LABEL rows of each label, those with the least hash), a fifth of which is held back for Platt scaling, so the
score is a probability. Documents are scored in Arrow batches against a fixed threshold.

Defined results: null text is the empty text, which fails the base rules; rows without a label teach nothing, a null label is
none, of several labels of an id the larger counts, and of several texts of an id the least is fitted; with labels of one kind only, or none, the model keeps all; repeated rows stay
repeated; a null id never finds a label; other columns are not looked at.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship
from . import common

BITS = 16
DIM = 1 << BITS
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
#: Base rules: fewest words, and percent of words in repeated windows of so many words.
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
#: Labelled rows of each label, at most, that the classifier is fitted on.
PER_LABEL = 1500
EPOCHS, RATE, L2 = 6, 0.5, 1e-5
#: Probability of good quality from which a document is kept.
THRESHOLD = 0.5
EXTRA = 6
_split = re.compile(f"[^{WHITE}]+").findall


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words that lie in a window of so many words found twice or more."""
    if len(words) <= window:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    n, have = len(number), 1
    while have < window:  # windows of 2, 4, 8 words get numbers that are equal just where their words are
        step = min(have, window - have)
        ids = ids[: len(ids) - step] * n + ids[step:]
        _, ids = np.unique(ids, return_inverse=True)
        n, have = int(ids.max()) + 1, have + step
        if n == len(ids):
            return 0
    hit = np.flatnonzero(np.bincount(ids)[ids] > 1)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + window, -1)
    return int(np.count_nonzero(np.cumsum(cover[:-1])))


def counts(text: str) -> tuple[list[str], int, int, int, int]:
    """(words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    words = _split(text)
    lines = [x for x in text.split("\n") if x.strip(WHITE)] if "\n" in text else []
    return words, len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat > MOST_REPEATED * n_words


def features(text: str, found=None) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, values) of a text; the last EXTRA numbers are shares of the whole."""
    words, chars, symbols, dup, repeat = found or counts(text)
    n = max(1, len(words))
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    three = np.zeros(0, np.uint32)
    if len(code) > 2:
        three = code[:-2] * np.uint32(0x9E3779B1) + code[1:-1] * np.uint32(0x85EBCA6B) + code[2:] * np.uint32(0xC2B2AE35)
        three = (three * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS)
    tf = np.bincount(three, minlength=DIM)
    at = np.flatnonzero(tf)
    grams = 1 + np.log(tf[at])
    seen = Counter(words)
    w = np.fromiter((zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in seen), np.uint32, len(seen))
    number = {x: k for k, x in enumerate(seen)}
    order = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    h = w[order] if len(words) else np.zeros(0, np.uint32)
    two = np.unique(h[:-1] * np.uint32(0x01000193) ^ h[1:]) if len(h) > 1 else np.zeros(0, np.uint32)
    ones = (w * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    twos = (two * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS)
    parts = [(at, grams), (DIM + ones, 1 + np.log(np.fromiter(seen.values(), float, len(seen)))), (2 * DIM + twos, np.ones(len(twos)))]
    number, value = zip(*[(a, v / (np.linalg.norm(v) or 1.0)) for a, v in parts])
    upper = sum(1 for x in seen if x.isupper() and len(x) > 1) / max(1, len(seen))
    extra = np.array([1.0, symbols / max(1, chars), repeat / n, 1 - len(seen) / n, upper, min(1.0, dup / (text.count("\n") + 1))])
    return np.concatenate([*number, 3 * DIM + np.arange(EXTRA)]).astype(np.int64), np.concatenate([*value, extra])


SIZE = 3 * DIM + EXTRA


class Model:
    """Weights, and the slope and shift that make a probability of a score; no weights: everything is good."""

    def __init__(self, weights: np.ndarray | None = None, slope: float = 1.0, shift: float = 0.0):
        self.weights, self.slope, self.shift = weights, slope, shift

    def score(self, text: str, found=None) -> float:
        if self.weights is None:
            return 1.0
        at, x = features(text, found)
        s = self.slope * float(self.weights[at] @ x) + self.shift
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, s))))


def _sigmoid(s: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(s, -500, 500)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """Weights by AdaGrad, classes weighed alike."""
    w, g2 = np.zeros(SIZE), np.full(SIZE, 1e-8)
    good = sum(y for *_, y in rows)
    weight = {1: len(rows) / (2 * max(1, good)), 0: len(rows) / (2 * max(1, len(rows) - good))}
    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for k in order.permutation(len(rows)):
            at, x, y = rows[k]
            g = (float(_sigmoid(w[at] @ x)) - y) * weight[y] * x + L2 * w[at]
            np.add.at(g2, at, g * g)
            w[at] -= RATE * g / np.sqrt(g2[at])
    return w


def platt(scores: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift with the least log loss, by Newton steps from smoothed targets."""
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a = np.array([1.0, 0.0])
    x = np.stack((scores, np.ones_like(scores)), axis=1)
    loss = lambda a: float(np.sum(np.logaddexp(0, x @ a) - t * (x @ a)))
    for _ in range(100):
        p = _sigmoid(x @ a)
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, x.T @ (p - t))
        while np.abs(step).max() > 1e-9 and loss(a - step) > loss(a):  # halved until it descends
            step /= 2
        a -= step
        if np.abs(step).max() <= 1e-9:
            break
    return (float(a[0]), float(a[1])) if a[0] > 0 else (1.0, 0.0)


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [features(t.as_py()) for t in b.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array([a.astype(np.int32) for a, _ in found], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for _, v in found], pa.list_(pa.float32())), b.column(1), b.column(2)], ["at", "x", "label", "h"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", per_label: int = PER_LABEL) -> Model:
    """A model from labelled rows; labels: 1 good, 0 bad. Labels that also mark a row toxic are not told from others."""
    ship(docs.sparkSession)
    known = labels.select(labels[label_id].alias("id"), labels[label_col].cast("int").alias("label")).where("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    total = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}  # two rows
    if set(total) != {0, 1}:
        return Model()
    known = known.withColumn("h", F.md5(F.concat(F.lit("quality:"), F.col("id").cast("string"))))
    share = F.when(F.col("label") == 1, (1.5 * per_label + 20) / total[1]).otherwise((1.5 * per_label + 20) / total[0])
    some = known.where(F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / float(1 << 32) <= share)
    some = some.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("h", "id"))).where(F.col("k") <= per_label).select("id", "label", "h")
    texts = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    one = texts.join(F.broadcast(some), "id").groupBy("h", "label").agg(F.min("text").alias("text"))  # of rows that repeat an id one, so at most 2 * per_label
    found = one.select("text", "label", "h").mapInArrow(_feature_batches, "at array<int>, x array<float>, label int, h string").toArrow()
    order = found.select(["h", "label"]).to_pandas().sort_values(["h", "label"], kind="stable").index[: 2 * per_label]
    at, x, label = (found.column(c).combine_chunks() for c in ("at", "x", "label"))
    data = [(at[int(k)].values.to_numpy(), x[int(k)].values.to_numpy(), label[int(k)].as_py()) for k in order]
    ahead, back = [r for k, r in enumerate(data) if k % 5], [r for k, r in enumerate(data) if not k % 5]
    if len({y for *_, y in ahead}) < 2:
        return Model()
    w = fit(ahead)
    return Model(w, *platt(np.array([w[a] @ x for a, x, _ in back]), np.array([y for *_, y in back])))


COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def _scorer(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            out = []
            for t in b.column(1):
                text = t.as_py() or ""
                found = counts(text)
                failed = base_failed(len(found[0]), found[4])
                p = 0.0 if failed else model.score(text, found)
                out.append((len(found[0]), *found[1:], failed, not failed and p >= threshold, p))
            columns = zip(*out) if out else [[]] * 8
            types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), k) for c, k in zip(columns, types))], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"])

    return run


def judge(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Counts, verdict and probability for every row of docs; score: 0 where a base rule fails."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(_scorer(shared, threshold), COLUMNS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return judge(docs, train(docs, common.table(spark, sf_dir, "labels")))
