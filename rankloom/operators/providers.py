"""Batch providers of vectors, answers and scores, with offline stand-ins.

A provider takes a list of texts and returns a list of results. It is called on distinct texts only, in Arrow batches ordered by length,
and its results are joined back to every row that asked.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Texts that a provider gets at once.
BATCH = 256


def _runs(texts: list[str], provider: Callable[[list[str]], list]) -> list:
    order = sorted(range(len(texts)), key=lambda k: len(texts[k]))
    out: list = [None] * len(texts)
    for at in range(0, len(order), BATCH):
        some = order[at : at + BATCH]
        for k, x in zip(some, provider([texts[k] for k in some])):
            out[k] = x
    return out


_TYPES = {"string": pa.string(), "double": pa.float64(), "array<float>": pa.list_(pa.float32()), "array<array<float>>": pa.list_(pa.list_(pa.float32()))}


def per_text(df: DataFrame, column: str, provider: Callable[[list[str]], list], out: str, kind: str, cache: DataFrame | None = None) -> DataFrame:
    """(column, out): the provider's result for each distinct text that the cache, a table of the same columns, does not have, and the cache's for the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_runs(b.column(0).to_pylist(), provider), _TYPES[kind])], [column, out])

    asked = df.select(column).where(F.col(column).isNotNull()).distinct()
    todo = asked if cache is None else asked.join(cache, column, "left_anti")
    made = todo.mapInArrow(run, f"{column} string, {out} {kind}")
    return made if cache is None else made.union(asked.join(cache, column).select(column, out))


def each(df: DataFrame, column: str, provider: Callable[[list[str]], list], out: str, kind: str) -> DataFrame:
    """df with the provider's results in the place of its texts, which are distinct already and not null: so they aren't shuffled to find that out."""
    kept = [c for c in df.columns if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*map(b.column, kept), pa.array(_runs(b.column(column).to_pylist(), provider), _TYPES[kind])], [*kept, out])

    return df.mapInArrow(run, StructType([*df.select(*kept).schema, *StructType.fromDDL(f"{out} {kind}")]))


def generate(df: DataFrame, prompt: str, provider: Callable[[list[str]], list[str]], cache: DataFrame | None = None) -> DataFrame:
    """df with answer: one call for each distinct prompt; the answer to a null prompt is null."""
    return with_result(df, prompt, per_text(df, prompt, provider, "answer", "string", cache))


def with_result(df: DataFrame, column: str, results: DataFrame) -> DataFrame:
    """df with the results (column, ...) of its texts; they meet by digest, so texts are shuffled no more. Rows with a null text stay, without a result."""
    keyed = results.withColumn("__key", F.sha2(column, 256)).drop(column)
    return df.withColumn("__key", F.sha2(column, 256)).join(keyed, "__key", "left").drop("__key")


def echo_digest(prompts: list[str]) -> list[str]:
    """Stand-in for a generator: an answer that depends on nothing but the prompt."""
    return ["answer " + hashlib.sha256(p.encode()).hexdigest()[:8] for p in prompts]


class _Places(dict):
    """Of each word the component that it counts in and whether it counts up there, as one number; let go when MOST words are held."""

    MOST = 1 << 18

    def __init__(self, width: int):
        self.width = width

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        h = int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "little")
        self[word] = place = h % self.width * 2 + (h >> 32 & 1)
        return place


_places = functools.cache(_Places)


def hashed_embedding(texts: list[str], width: int = 32) -> list[list[float]]:
    """Stand-in for an embedder: a hashed bag of words, scaled to length 1."""
    out, place = [], _places(width).__getitem__
    for t in texts:
        n = [0] * (2 * width)
        for k in map(place, t.lower().split()):
            n[k] += 1
        v = [float(up - down) for down, up in zip(n[::2], n[1::2])]
        size = sum(x * x for x in v) ** 0.5 or 1.0
        out.append([x / size for x in v])
    return out


def hidden_states(texts: list[str], layers: int = 3, width: int = 8) -> list[list[list[float]]]:
    """Stand-in for hidden states at the last word: one vector a layer."""
    return [[hashed_embedding([f"{layer} {' '.join(t.split()[-8:])}"], width)[0] for layer in range(layers)] for t in texts]


def judge(texts: list[str]) -> list[str]:
    """Stand-in for a judge: JSON or free text with a score from 0 to 1, now and then none."""
    out = []
    for t in texts:
        h = hashlib.md5(t.encode()).digest()[0]
        out.append("no idea" if h < 16 else json.dumps({"score": round(h / 255, 2)}) if h % 2 else f"I'd say {h / 255:.2f}")
    return out
