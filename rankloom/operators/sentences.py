"""Sentences with their places, and abbreviations learned from the corpus without labels.

A word type is taken for an abbreviation if its occurrences go together with a full stop far more than stops do with words at large: the log-likelihood ratio of that, times factors for
its length (short ones), its inner stops and its occurrences without a stop, reaches THRESHOLD. Counts are aggregates over all texts. A text is then cut after
stops, question and exclamation marks, with closing quotes and brackets, before white space or the end; but not after an abbreviation, an initial, or a number
before a word in lower case. A blank line ends a sentence in any case.

Spans are 0-based code points, ends exclusive, without the white space around; between two spans of a text there is white space only. A null text has null spans, one without a word none.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shipping import ship

THRESHOLD = 0.3
#: Abbreviations that a model has at most, those of the highest score; it is sent to every task.
MOST = 100_000
#: What may stand around a word.
OPEN, CLOSE = "(\"'\\[«„“‘", ")\"'\\]»”’"
_END = re.compile(rf"[.!?…]+[{CLOSE}]*(?=\s|$)|\n[^\S\n]*(?=\n)")
_SPACE = re.compile(r"\s+")


def word_counts(texts: DataFrame, text: str) -> DataFrame:
    """(type, n, stops): occurrences of each word type in lower case, without its final stop, and how many have one; types have a letter."""
    words = texts.select(F.explode(F.split(text, r"\s+")).alias("w"))
    bare = words.select(F.regexp_replace(F.regexp_replace("w", f"^[{OPEN}]+", ""), f"[{CLOSE}]+$", "").alias("w")).where(F.col("w") != "")
    typed = bare.select(F.lower(F.regexp_replace("w", r"\.$", "")).alias("type"), F.endswith("w", F.lit(".")).cast("long").alias("stop"))
    return typed.where(F.col("type").rlike(r"\p{L}")).groupBy("type").agg(F.count("*").alias("n"), F.sum("stop").alias("stops"))


def abbreviations(texts: DataFrame, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """(type, n, stops, score) of the types whose score reaches the threshold."""
    counts = word_counts(texts, text)
    whole = counts.agg(F.sum("n").alias("__n"), F.sum("stops").alias("__s"))
    rate, without = F.col("__s") / F.col("__n"), F.col("n") - F.col("stops")
    chance = F.col("stops") * F.log(rate) + without * F.log(1 - rate)
    tied = F.col("stops") * F.log(F.lit(0.99)) + without * F.log(F.lit(0.01))
    letters = F.length(F.replace("type", F.lit("."), F.lit("")))
    inner = F.length("type") - letters + 1
    score = -2 * (chance - tied) * F.exp(-letters) * inner * F.pow(letters.cast("double"), -without)
    rows = counts.where("stops > 0").crossJoin(F.broadcast(whole)).where("__s < __n")  # one row
    return rows.withColumn("score", score).where(F.col("score") >= threshold).drop("__n", "__s")


def spans(text: str, known: frozenset[str] | set[str]) -> list[tuple[int, int]]:
    """(start, end) of each sentence."""
    out, start = [], 0

    def add(end: int) -> None:
        nonlocal start
        part = text[start:end]
        if kept := part.strip():
            at = start + len(part) - len(part.lstrip())
            out.append((at, at + len(kept)))
        start = end

    for found in _END.finditer(text):
        if found[0].rstrip(CLOSE + "\\") == "." and not _ends(text, start, found, known):
            continue
        add(found.end())
    add(len(text))
    return out


def _ends(text: str, start: int, stop: re.Match, known: frozenset[str] | set[str]) -> bool:
    """Whether a full stop ends a sentence; start: where the sentence began."""
    at = stop.start()
    while at > start and not text[at - 1].isspace():
        at -= 1
    word = text[at : stop.start()].lstrip(OPEN)
    after = _SPACE.match(text, stop.end())
    following = text[after.end()] if after and after.end() < len(text) else ""
    if not following or "\n\n" in (after[0] if after else ""):
        return True
    if len(word) == 1 and word.isalpha() and word.isupper():
        return False
    if word.replace(",", "").replace(".", "").isdigit() and following.islower():
        return False
    return word.lower() not in known


#: Characters of text whose spans are held at once.
TEXT = 1 << 20


def _split_batches(batches: Iterator[pa.RecordBatch], at: int, known: frozenset[str] | set[str], out: str) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about TEXT characters, with the spans of column `at` as numbers beside each other."""
    for b in batches:
        first, size, offsets, starts, ends = 0, 0, array("i", [0]), array("i"), array("i")
        for k, t in enumerate(b.column(at)):
            if t.is_valid:
                text = t.as_py()
                size += len(text)
                for s, e in spans(text, known):
                    starts.append(s)
                    ends.append(e)
            offsets.append(len(starts))
            if size >= TEXT or k + 1 == b.num_rows:
                part = b.slice(first, k + 1 - first)
                pairs = pa.StructArray.from_arrays([pa.array(np.frombuffer(x, np.int32)) if x else pa.array([], pa.int32()) for x in (starts, ends)], ["start", "end"])
                found = pa.ListArray.from_arrays(pa.array(np.frombuffer(offsets, np.int32)), pairs, mask=pa.array(part.column(at).is_null()))
                yield pa.RecordBatch.from_arrays([*part.columns, found], [*b.schema.names, out])
                first, size, offsets, starts, ends = k + 1, 0, array("i", [0]), array("i"), array("i")


def split(df: DataFrame, text: str, model: DataFrame, out: str = "sentences") -> DataFrame:
    """df with the spans of each text; model: a table of abbreviations (type, score)."""
    spark = ship(df.sparkSession)
    best = [r["type"] for r in model.orderBy(F.desc("score"), "type").limit(MOST).select("type").collect()]
    shared, at = spark.sparkContext.broadcast(frozenset(best)), df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _split_batches(batches, at, shared.value, out)

    return df.mapInArrow(run, StructType([*df.schema.fields, *StructType.fromDDL(f"`{out}` array<struct<start: int, end: int>>").fields]))
