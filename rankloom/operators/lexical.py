"""Lexical floors: TF-IDF of word 1- and 2-grams and logistic regressions of all folds at once, with no vocabulary and no weights in one place.

Grams are dealt into blocks by 64-bit hashes; a block keeps, for each of its grams, the texts that have it and how often. The weights of a model are sums over its texts
of their vectors, so a model is one number a text: a step of all models is one pass over the blocks, X (X' v), and a search along known steps needs none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from ..sources import scratch
from . import sampling, stats

#: Squared penalty on weights of features of deviation 1, over the mean loss.
PENALTY = 0.01
#: Steps end when no model can be bettered by more than this share of its loss, by its gradient and penalty; a step is the best in the span of the gradient and the last steps.
TOLERANCE, MOST_STEPS, KEPT = 1e-9, 200, 6
#: Words that are counted at once, texts in a row of sums.
WORDS, SLICE = 1_000_000, 1 << 15
#: Characters for which there is a block of grams, and the most blocks: work on a block is that of its grams and of the texts.
BLOCK, MOST_BLOCKS = 2_000_000, 256


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of pairs of words from hashes of words."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + ((b << np.uint64(31)) | (b >> np.uint64(33))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _postings(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each block: texts, grams and counts, as bytes."""
        for b in batches:
            at, lists = b.column(0).to_numpy(), b.column(1)
            ends, flat = np.cumsum(np.concatenate(([0], lists.value_lengths().to_numpy()))), lists.flatten().to_numpy().view(np.uint64)
            first = 0
            while first < len(at):
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + WORDS, "right")) - 1)
                keys, counts, sizes = [], [], []
                for i in range(first, last):
                    h = flat[ends[i] : ends[i + 1]]
                    k, c = np.unique(np.concatenate((h, paired(h[:-1], h[1:]))), return_counts=True)
                    keys.append(k), counts.append(c.astype(np.int32)), sizes.append(len(k))
                key, count, text = np.concatenate(keys), np.concatenate(counts), np.repeat(at[first:last].astype(np.int32), sizes)
                block = (key >> np.uint64(64 - bits)).astype(np.uint16)
                order = np.argsort(block, kind="stable")
                key, count, text, block = key[order], count[order], text[order], block[order]
                cuts = np.flatnonzero(np.concatenate(([len(block) > 0], block[1:] != block[:-1])))
                spans = list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(block)]))
                parts = [pa.array([x[s:e].tobytes() for s, e in spans], pa.binary()) for x in (text, key, count)]
                yield pa.RecordBatch.from_arrays([pa.array(block[cuts].astype(np.int32)), *parts], ["block", "text", "key", "count"])
                first = last

    return run


class Design:
    """Sides, folds and weights of the texts, by their numbers: those of a label stand together, dealt into folds in turn. labels: (label, texts), null has no side and is in no fit."""

    def __init__(self, labels: list[tuple[float | None, int]], k: int):
        self.k, self.n = k, sum(n for _, n in labels)
        self.fold = np.concatenate([np.arange(n) % k for _, n in labels] or [np.zeros(0, int)]).astype(np.int8)
        of = np.repeat(np.arange(len(labels)), [n for _, n in labels])
        known, positive = np.array([x is not None for x, _ in labels], bool), np.array([x is not None and x > 0 for x, _ in labels], bool)
        self.side, self.known = positive[of], known[of]
        self.member = (self.fold != np.arange(k)[:, None]) & self.known
        self.weight = np.zeros((k, self.n))
        for f in range(k):
            sizes = np.bincount(of[self.member[f]], minlength=len(labels))
            self.weight[f] = np.where(self.member[f], (sizes.sum() / (2 * np.maximum(sizes, 1)))[of], 0.0)
            if not (sizes[positive].any() and sizes[known & ~positive].any()):
                self.weight[f] = 0.0


def _columns(min_df: int):
    def block(rows: list[tuple[bytes, bytes, bytes]]) -> list[bytes] | None:
        text, key, count = (np.concatenate([np.frombuffer(r[i], t) for r in rows]) for i, t in enumerate((np.int32, np.uint64, np.int32)))
        order = np.argsort(key, kind="stable")
        text, key, count = text[order], key[order], count[order]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.append(starts, len(key)))
        keep = sizes >= min_df
        if not keep.any():
            return None
        on = np.repeat(keep, sizes)
        return [text[on].tobytes(), count[on].tobytes(), sizes[keep].astype(np.int32).tobytes()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each block: texts and counts, gram by gram, and how many texts each gram has; grams of fewer than min_df texts are in no model."""
        held, rows = None, []

        def done():
            made = block(rows) if rows else None
            if made:
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in made], ["text", "count", "sizes"])

        for b in batches:
            for i, row in zip(b.column(0).to_pylist(), zip(*(b.column(c).to_pylist() for c in (1, 2, 3)))):
                if i != held:
                    yield from done()
                    held, rows = i, []
                rows.append(row)
        yield from done()

    return run


def _read(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    for i in range(b.num_rows):
        yield tuple(np.frombuffer(b.column(c)[i].as_buffer(), t) for c, t in enumerate((np.int32, np.int32, np.int32, np.float64)[: b.num_columns]))


def _idf(design: Design, f: int, text: np.ndarray, starts: np.ndarray, min_df: int) -> np.ndarray:
    """Of each gram in a fold's model; 0 for a gram of fewer texts than min_df."""
    df = np.add.reduceat(design.member[f][text].astype(np.int64), starts)
    return np.where(df >= min_df, np.log((design.member[f].sum() + 1) / (df + 1)), 0.0)


def _scaled(shared, min_df: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The blocks with each gram's factor in each model: its idf over the weighted deviation of its feature; grams without any are left out."""
        design, inverse = shared.value
        for b in batches:
            for text, count, sizes in _read(b):
                starts, scale = np.cumsum(sizes) - sizes, np.zeros((design.k, len(sizes)))
                for f in range(design.k):
                    w, idf = design.weight[f], _idf(design, f, text, starts, min_df)
                    x = count * inverse[f][text]
                    total, squares = w.sum(), (w * w).sum()
                    if not total:
                        continue
                    one, two = np.add.reduceat(w[text] * x, starts), np.add.reduceat(w[text] * x * x, starts)
                    rest = two - one * one / total
                    varies = (idf != 0) & (rest > 1e-12 * two)
                    scale[f][varies] = 1 / np.sqrt(rest[varies] / (total - squares / total))  # idf is a factor of feature and deviation alike
                keep = scale.any(0)
                if keep.any():
                    on = np.repeat(keep, sizes)
                    made = text[on], count[on], sizes[keep], scale[:, keep]
                    yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in made], ["text", "count", "sizes", "scale"])

    return run


def _sums(shared, min_df: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums over the grams of each text in each model: of squared TF-IDF where there is no v, else X (X' v)."""
        design, v = shared.value
        out, none = np.zeros((design.k, design.n)), True
        for b in batches:
            for text, count, sizes, *rest in _read(b):
                starts, gram, none = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes), False
                text, count = text.astype(np.intp), count.astype(float)
                for f in range(design.k):
                    if v is None:
                        add = (_idf(design, f, text, starts, min_df)[gram] * count) ** 2
                    elif v[f].any():
                        add = (np.add.reduceat(v[f][text] * count, starts) * rest[0].reshape(design.k, -1)[f] ** 2)[gram] * count
                    else:
                        continue
                    out[f] += np.bincount(text, add, design.n)
        for s in range(0, 0 if none else design.n, SLICE):
            yield pa.RecordBatch.from_arrays([pa.array([s // SLICE], pa.int32()), pa.array([out[:, s : s + SLICE].tobytes()], pa.binary())], ["slice", "sums"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for s, x in zip(b.column(0).to_pylist(), b.column(1)):
            x = np.frombuffer(x.as_buffer())
            if s in sums:
                sums[s] += x
            else:
                sums[s] = x.copy()
    for s, x in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["slice", "sums"])


def _whole(blocks: DataFrame, design: Design, v: np.ndarray | None, min_df: int = 0) -> np.ndarray:
    """_sums over all blocks, models x texts."""
    shared = blocks.sparkSession.sparkContext.broadcast((design, v))
    parts = blocks.mapInArrow(_sums(shared, min_df), "slice int, sums binary")
    out = np.zeros((design.k, design.n))
    for r in parts.repartition(min(64, -(-design.n // SLICE) or 1), "slice").mapInArrow(_added, "slice int, sums binary").collect():  # a number a text and model
        s = r["slice"] * SLICE
        out[:, s : s + SLICE] = np.frombuffer(r["sums"]).reshape(design.k, -1)
    shared.destroy()
    return out


class _Model:
    """One fold's regression: a coefficient for each text, margins, an intercept without penalty, and the last steps with their products."""

    def __init__(self, weight: np.ndarray, side: np.ndarray):
        self.on = np.flatnonzero(weight)
        self.q, self.y = weight[self.on] / max(weight.sum(), 1e-300), side[self.on]
        self.sign = np.where(self.y, -1.0, 1.0)
        self.a, self.z, self.b, self.past, self.ended = np.zeros(len(self.on)), np.zeros(len(weight)), 0.0, [], not len(self.on)

    def asked(self) -> np.ndarray:
        """The gradient, whose product the next step needs."""
        p = 1 / (1 + np.exp(-np.clip(self.z[self.on] + self.b, -500, 500)))
        self.g = self.q * (p - self.y) + PENALTY * self.a
        return self.g

    def step(self, product: np.ndarray) -> None:
        """The least loss over the gradient, the last steps and the intercept, by Newton steps."""
        ways, products = [self.g, *(x for x, _ in self.past)], [product, *(x for _, x in self.past)]
        u = np.stack([x[self.on] for x in products] + [np.ones(len(self.on))], 1)
        norm = np.maximum(np.sqrt((self.q[:, None] * u * u).sum(0)), 1e-300)
        u /= norm
        ways, products = [x / s for x, s in zip(ways, norm)], [x / s for x, s in zip(products, norm)]
        m = len(ways)
        flat, square = np.zeros(m + 1), np.zeros((m + 1, m + 1))
        flat[:m] = [self.a @ x[self.on] for x in products]
        square[:m, :m] = [[w @ x[self.on] for x in products] for w in ways]
        square = (square + square.T) / 2
        base, own = self.z[self.on] + self.b, self.a @ self.z[self.on]
        t = np.zeros(m + 1)

        def loss(t):
            return self.q @ np.logaddexp(0, self.sign * (base + u @ t)) + PENALTY / 2 * (own + 2 * flat @ t + t @ square @ t)

        now = loss(t)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(base + u @ t, -500, 500)))
            g = (self.q * (p - self.y)) @ u + PENALTY * (flat + square @ t)
            h = (u * (self.q * p * (1 - p))[:, None]).T @ u + PENALTY * square
            move = -np.linalg.lstsq(h, g, rcond=1e-13)[0]
            gain, share = -(g @ move), 1.0
            while gain > 0 and share > 1e-9 and not (new := loss(t + share * move)) <= now - 1e-4 * share * gain:
                share /= 2
            if gain <= 0 or share <= 1e-9:
                break
            t, now = t + share * move, new
            if gain <= 1e-15 * now:
                break
        way, moved = sum(s * x for s, x in zip(t, ways)), sum(s * x for s, x in zip(t, products))
        self.a, self.z, self.b = self.a + way, self.z + moved, self.b + t[-1] / norm[-1]
        self.past = [(way, moved), *self.past][:KEPT]
        self.ended = self.g @ product[self.on] <= 2 * PENALTY * TOLERANCE * now  # the squared gradient over twice the penalty is the most that there was to win


def scores(df: DataFrame, text: str, label: str, key: str, k: int = 5, seed: int = 42, min_df: int = 2) -> DataFrame:
    """(y, score): every text's margin in the model of the other folds; y: its label is over 0.

    A model has TF-IDF of the words and pairs of neighbours in at least min_df of its texts, rows of length 1, features over their deviation, classes weighing alike, squared penalty.
    A null text is the empty text; a null label is scored and in no fit; without both sides a model scores all texts 0.
    """
    spark = ship(df.sparkSession)
    rows = sampling.in_hash_order(df.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"), F.col(label).alias("label")), ["label"], seed, "key", out="place")
    found = rows.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).collect()  # a row a label
    found.sort(key=lambda r: (r["label"] is None, r["label"] or 0.0))
    design, at, before = Design([(r["label"], r["n"]) for r in found], k), F.lit(None), 0
    for r in found:
        at = F.when(F.col("label").eqNullSafe(F.lit(r["label"])), F.col("place") - 1 + before).otherwise(at)
        before += r["n"]
    bits = max(1, int(np.ceil(np.log2(min(MOST_BLOCKS, max(16, sum(r["chars"] for r in found) / BLOCK))))))
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    hashed = rows.select(at.cast("long").alias("at"), F.transform(words, lambda w: F.xxhash64(w)).alias("words"))
    dealt = hashed.mapInArrow(_postings(bits), "block int, text binary, key binary, count binary").repartition("block").sortWithinPartitions("block")
    raw = scratch.new_path(spark, "grams")
    dealt.mapInArrow(_columns(min_df), "text binary, count binary, sizes binary").write.parquet(raw)
    grams = spark.read.schema("text binary, count binary, sizes binary").parquet(raw)
    norms = np.sqrt(_whole(grams, design, None, min_df))
    shared = spark.sparkContext.broadcast((design, np.divide(1, norms, out=np.zeros_like(norms), where=norms > 0)))
    inverse = shared.value[1]
    blocks = scratch.cut(grams.mapInArrow(_scaled(shared, min_df), "text binary, count binary, sizes binary, scale binary"), "features")
    shared.destroy()
    scratch.delete(spark, raw)
    models = [_Model(design.weight[f], design.side) for f in range(k)]
    for _ in range(MOST_STEPS):
        if all(m.ended for m in models):
            break
        v = np.zeros((k, design.n))
        for f, m in enumerate(models):
            if not m.ended:
                v[f][m.on] = m.asked()
        products = _whole(blocks, design, v * inverse) * inverse
        for f, m in enumerate(models):
            if not m.ended:
                m.step(products[f])
    score = np.choose(design.fold, [m.z + m.b for m in models]) if design.n else np.zeros(0)
    y = pa.array(design.side, pa.bool_(), mask=~design.known)
    return spark.createDataFrame(pa.table({"y": y, "score": pa.array(score, pa.float64())}))


def floor(df: DataFrame, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """(auroc) of out-of-fold scores of texts over (key, text, label)."""
    return stats.auroc(scores(df, "text", "label", key, k, seed), [], "score", "y")
