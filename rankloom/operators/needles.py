"""Many needles in whole texts: an Aho-Corasick automaton, run once along each text in Arrow batches.

Needles are a list, or a table. A table's needles are read in shards of at most SHARD characters, those that begin alike together, so an automaton has a bound; each shard
is one pass over the texts. Lower-casing and the squeezing of white space are left to the engine, once a text; places are 0-based code points, ends exclusive.
Null texts have no hits; empty needles are in every text that isn't null, at 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shipping import ship

#: Characters of needles in one automaton.
SHARD = 4_000_000
#: What a whole word must not touch.
WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789_")


class Needles:
    """An automaton over distinct needles; each knows the places of its copies in the list."""

    def __init__(self, needles: list[str]):
        self.places: dict[str, list[int]] = {}
        for k, needle in enumerate(needles):
            self.places.setdefault(needle, []).append(k)
        self.empty = self.places.pop("", [])
        self.longest = max(map(len, self.places), default=0)
        self.automaton = ahocorasick.Automaton()
        for needle, at in self.places.items():
            self.automaton.add_word(needle, (len(needle), at))
        if self.places:
            self.automaton.make_automaton()

    def hits(self, text: str) -> Iterator[tuple[int, int, list[int]]]:
        """(start, end, places) of every occurrence that isn't empty, by its end."""
        if self.places:
            for last, (size, at) in self.automaton.iter(text):
                yield last + 1 - size, last + 1, at

    def found(self, text: str, whole: frozenset[int] = frozenset()) -> set[int]:
        """Places of the needles in the text; those of whole count as whole words only."""
        out, open_ = set(self.empty), sum(map(len, self.places.values()))
        for start, end, at in self.hits(text):
            new = [k for k in at if k not in out and (k not in whole or not touches(text, start, end))]
            if new:
                out.update(new)
                open_ -= len(new)
                if not open_:
                    break
        return out

    def earliest(self, text: str, bounded: bool = False) -> tuple[int, int] | None:
        """The occurrence that starts first; of those that start together, that of the needle first in the list."""
        best = None
        for start, end, at in self.hits(text):
            if best and end - self.longest > best[0]:
                break  # whatever follows starts later
            if (best is None or (start, at[0]) < best[:2]) and not (bounded and touches(text, start, end)):
                best = (start, at[0], end)
        return best and (best[0], best[2])


def touches(text: str, start: int, end: int) -> bool:
    """Whether an occurrence goes on into the word beside it."""
    return (start > 0 and text[start - 1] in WORD) or (end < len(text) and text[end] in WORD)


def _schema(df: DataFrame, more: str) -> StructType:
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


def first_spans(df: DataFrame, text: Column, needles: list[str], out: str, bounded: bool = False) -> DataFrame:
    """df with out, struct(start, end) of the earliest occurrence of any needle that isn't empty; null without one."""
    ship(df.sparkSession)
    rows, n = df.withColumn("__t", text), len(df.columns)
    kind = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Needles(needles)
        for b in batches:
            spans = [t.is_valid and found.earliest(t.as_py(), bounded) or None for t in b.column(n)]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array([s and {"start": s[0], "end": s[1]} for s in spans], kind)], [*b.schema.names[:n], out])

    return rows.mapInArrow(run, _schema(df, f"`{out}` struct<start: long, end: long>"))


def flags(df: DataFrame, texts: dict[str, Column], rules: dict[str, tuple[str, list[tuple[str, bool]]]]) -> DataFrame:
    """df with a boolean for each rule: whether any of its needles is in the text that it names; a needle is (string, as a whole word only). False for a null text."""
    ship(df.sparkSession)
    n, names = len(df.columns), list(texts)
    rows = df.select("*", *[c.alias(f"__t{k}") for k, c in enumerate(texts.values())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_text = []
        for name in names:
            listed = [(needle, whole, rule) for rule, (of, wanted) in rules.items() if of == name for needle, whole in wanted]
            of_text.append((Needles([x for x, _, _ in listed]), frozenset(k for k, x in enumerate(listed) if x[1]), [rule for _, _, rule in listed]))
        for b in batches:
            found = [set() for _ in range(b.num_rows)]
            for k, (needles, whole, rule) in enumerate(of_text):
                for row, t in zip(found, b.column(n + k)):
                    if t.is_valid:
                        row.update(rule[x] for x in needles.found(t.as_py(), whole))
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *[pa.array([r in row for row in found], pa.bool_()) for r in rules]], [*b.schema.names[:n], *rules])

    return rows.mapInArrow(run, _schema(df, ", ".join(f"`{r}` boolean" for r in rules)))


def contained(texts: DataFrame, items: DataFrame, shard: int = SHARD) -> DataFrame:
    """(id, item) for every item that a text contains, once a row of each; texts: (id, text), items: (item, needle), by their places. Null needles are in no text."""
    spark = ship(texts.sparkSession)
    (ident, text), (item, needle) = texts.columns, items.columns
    items = items.where(F.col(needle).isNotNull())
    size = items.agg(F.sum(F.length(needle) + 1)).first()[0] or 0
    shards = max(1, -(-size // shard))
    schema = StructType([texts.schema[ident], items.schema[item]])
    found = []
    for k in range(shards):
        here = items if shards == 1 else items.where(F.pmod(F.xxhash64(F.substring(needle, 1, 8)), F.lit(shards)) == k)
        shared = spark.sparkContext.broadcast(here.select(item, needle).toArrow())  # about SHARD characters

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            listed = shared.value
            needles = Needles(listed.column(1).to_pylist())
            keys = listed.column(0).combine_chunks() if listed.num_rows else pa.array([], listed.schema.field(0).type)
            for b in batches:
                hits = [sorted(needles.found(t.as_py())) if t.is_valid else [] for t in b.column(1)]
                at = pa.array([r for r, x in enumerate(hits) for _ in x], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), keys.take(pa.array([k for x in hits for k in x], pa.int64()))], [ident, item])

        found.append(texts.select(ident, text).mapInArrow(run, schema))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
