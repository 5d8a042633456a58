"""Source divergence audit: how far the vocabulary of each source of a language is from that of the others and from the whole.

A first pass lays the documents out in chunks, each of one language and of bounded size, and counts the documents of every term exactly; terms
in at least LEAST_DOCS documents of their language are its vocabulary. The vocabulary goes back to the chunks, each getting what occurs in it,
so no task holds more terms than its chunk has. In the second pass an Aho-Corasick automaton of a chunk's terms, padded with the delimiter,
counts their occurrences by source. The counts are sparse postings (lang, source, term, count). A pair of sources differs from two groups
without any term only where one of them has a posting: the part of one source's postings alone depends on their count only and is summed over
histograms of counts; the part of both is summed term by term, in blocks of sources. All values are whole numbers.

Defined results: null text, lang and source are empty strings, which are a language and a source as any other; repeated rows count each for
itself; a source without any term, or in a language without vocabulary, has its pairs nevertheless; a language with one source has no pairs;
equal values rank by the item's UTF-8 bytes; an empty table gives an empty result; only the named columns are looked at.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship
from . import common

LEAST_DOCS = 3
SCALE = 1_000_000_000
TOP = 200
#: Bytes of text after which a chunk is closed, and those that all open chunks of a task hold together.
CHUNK, OPEN = 16 << 20, 32 << 20
#: Sources of one block of a language, on average.
BLOCK = 64
#: Pairs of postings that a task holds at once.
PAIRS = 1 << 20
#: What a UTF-8 byte becomes: letters of terms stay, A-Z in lower case, all else is the delimiter.
_FOLD = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_CHUNKS = "chunk long, lang string, sources array<string>, texts array<binary>, terms array<string>, dfs array<long>"


def folded(text: str | None) -> bytes:
    """The text's terms, lower-cased, between delimiters."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)


class _Chunk:
    def __init__(self):
        self.size, self.texts, self.df = 0, defaultdict(list), Counter()

    def add(self, source: str, text: bytes) -> None:
        self.size += len(text) + 1
        self.texts[source].append(text)
        self.df.update(set(text.split()))


def _chunk_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("chunk", pa.int64()), ("lang", pa.string()), ("sources", pa.list_(pa.string())), ("texts", pa.list_(pa.binary())), ("terms", pa.list_(pa.string())), ("dfs", pa.list_(pa.int64()))])
    made, chunks, packed = TaskContext.get().partitionId() << 32, defaultdict(_Chunk), zstandard.ZstdCompressor()

    def closed(lang: str) -> pa.RecordBatch:
        nonlocal made
        c = chunks.pop(lang)
        terms = [t.decode("utf-8", "replace") for t in c.df]
        row = {"chunk": made, "lang": lang, "sources": list(c.texts), "texts": [packed.compress(b" ".join(x)) for x in c.texts.values()], "terms": terms, "dfs": list(c.df.values())}
        made += 1
        return pa.RecordBatch.from_pylist([row], schema)

    for b in batches:
        for lang, source, text in zip(*(b.column(k) for k in range(3))):
            lang = lang.as_py()
            chunks[lang].add(source.as_py(), folded(text.as_py()))
            if chunks[lang].size >= CHUNK:
                yield closed(lang)
            elif sum(c.size for c in chunks.values()) >= OPEN:
                yield closed(max(chunks, key=lambda x: chunks[x].size))
    for lang in list(chunks):
        yield closed(lang)


def _recount(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of the kept terms of each chunk, by source."""
    packed = zstandard.ZstdDecompressor()
    for b in batches:
        for lang, sources, texts, terms in zip(*(b.column(c) for c in ("lang", "sources", "texts", "kept"))):
            automaton = ahocorasick.Automaton()
            for k, t in enumerate(terms.as_py()):
                automaton.add_word(f" {t} ", k)
            automaton.make_automaton()
            for source, text in zip(sources.values, texts.values):
                # a delimiter belongs to the term before it and to that after it, as matches may overlap
                text = packed.decompress(text.as_py()).decode("utf-8", "replace")
                n = np.bincount(np.fromiter(map(itemgetter(1), automaton.iter(f" {text} ")), np.int64), minlength=len(terms))
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(at)), pa.repeat(source, len(at)), terms.values.take(pa.array(at)), pa.array(n[at])], ["lang", "source", "term", "n"])


def vocabulary(chunks: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term) of the terms in at least so many documents of their language."""
    each = chunks.select("lang", F.explode(F.arrays_zip("terms", "dfs")).alias("x")).select("lang", F.col("x.terms").alias("term"), F.col("x.dfs").alias("df"))
    return each.groupBy("term", "lang").agg(F.sum("df").alias("df")).where(F.col("df") >= least_docs).select("lang", "term")


def postings(chunks: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, term, n) for n > 0."""
    here = chunks.select("chunk", "lang", F.explode("terms").alias("term")).join(kept, ["term", "lang"])
    of_chunk = here.groupBy("chunk").agg(F.collect_list("term").alias("kept"))  # no more than the chunk's own terms
    counted = chunks.select("chunk", "lang", "sources", "texts").join(of_chunk, "chunk").select("lang", "sources", "texts", "kept").mapInArrow(_recount, "lang string, source string, term string, n long")
    return counted.groupBy("term", "source", "lang").agg(F.sum("n").alias("n"))


def _per_mille(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + v)), whole numbers throughout."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", F.lit(SCALE).cast("decimal(12,0)") * (wide(n) + 1), (wide(total) + wide(v)).cast("decimal(21,0)")) + 1


def _gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _compared(top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows of one term's postings in two blocks of sources: for each pair, the sum over its common terms of what the sums over either alone get
        wrong; and of each group's own terms the best, as many as can be among the first of all."""
        for b in batches:
            found, lists = b.column("found"), b.column("found").values
            sizes = np.diff(found.offsets.to_numpy())
            row = np.repeat(np.arange(b.num_rows), sizes)
            lists = lists.slice(found.offsets[0].as_py(), len(row))
            block, p, p0, q = (lists.field(k).to_numpy() for k in (0, 2, 3, 4))
            i, j = (b.column(c).to_numpy()[row] for c in ("i", "j"))
            langs, sources = (x.dictionary_encode() for x in (b.column("lang"), lists.field(1)))
            n_sources = max(1, len(sources.dictionary))
            group = langs.indices.to_numpy()[row].astype(np.int64) * n_sources + sources.indices.to_numpy()

            def told(part: str, group: np.ndarray, items: pa.Array, value: np.ndarray) -> pa.RecordBatch:
                arrays = [langs.dictionary.take(pa.array(group // n_sources)), sources.dictionary.take(pa.array(group % n_sources)), pa.repeat(part, len(group)), items, pa.array(value)]
                return pa.RecordBatch.from_arrays(arrays, ["lang", "source", "part", "item", "value"])

            own = np.flatnonzero((i == j) & (p > q))
            value = _gaps(p[own], q[own])
            by_bytes = np.empty(b.num_rows, np.int64)
            by_bytes[pc.sort_indices(b.column("term")).to_numpy()] = np.arange(b.num_rows)
            order = np.lexsort((by_bytes[row[own]], -value, group[own]))
            begin = np.flatnonzero(np.diff(group[own][order], prepend=-1))
            within = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
            best = order[within < top]
            yield told("term", group[own][best], b.column("term").take(pa.array(row[own][best])), value[best])

            ends = np.cumsum(sizes)
            squares = np.cumsum(sizes * sizes)
            first = 0
            while first < b.num_rows:  # rows whose pairs are held together
                last = max(first + 1, int(np.searchsorted(squares, (squares[first - 1] if first else 0) + PAIRS, "right")))
                d = sizes[first:last]
                begin = ends[first:last] - d
                left = np.repeat(np.arange(begin[0], ends[last - 1]), np.repeat(d, d))
                right = np.arange(len(left)) - np.repeat(np.cumsum(d * d) - d * d, d * d)
                right = right % np.repeat(d, d * d) + np.repeat(begin, d * d)
                on = (left != right) & ((i[left] == j[left]) | (block[left] != block[right]))
                left, right = left[on], right[on]
                gaps = _gaps(p[left], p[right]) - _gaps(p[left], p0[right]) - _gaps(p0[left], p[right]) + _gaps(p0[left], p0[right])
                pairs, at = np.unique(group[left] * n_sources + group[right] % n_sources, return_inverse=True)
                sums = np.zeros(len(pairs), np.int64)
                np.add.at(sums, at, gaps)
                yield told("pair", pairs // n_sources, sources.dictionary.take(pa.array(pairs % n_sources)), sums)
                first = last

    return run


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): pairs of sources in whole, terms to the rank top."""
    ship(docs.sparkSession)
    text, lang, source = (F.coalesce(docs[c].cast("string"), F.lit("")) for c in (text_col, lang_col, source_col))
    chunks = common.cut(docs.select(lang.alias("lang"), source.alias("source"), text.alias("text")).mapInArrow(_chunk_batches, _CHUNKS), "chunks")
    kept = common.cut(vocabulary(chunks, least_docs), "vocabulary")
    found = common.cut(postings(chunks, kept), "postings")

    # one row a group, with its totals and its language's, and the p of a term that it doesn't have
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
    groups = chunks.select("lang", F.explode("sources").alias("source")).distinct().join(found.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    groups = common.cut(groups.join(sizes, "lang", "left").na.fill(0, ["total", "v"]), "sources")
    common.drop_cut(chunks)
    whole = groups.groupBy("lang").agg(F.sum("total").alias("of_lang"), F.count("*").alias("sources"))
    groups = common.cut(groups.join(whole, "lang").withColumn("p0", F.when(F.col("v") > 0, _per_mille(F.lit(0), F.col("total"), F.col("v")))), "groups")
    scored = found.join(groups, ["lang", "source"]).withColumn("p", _per_mille(F.col("n"), F.col("total"), F.col("v")))

    # every ordered pair of one language's sources is a row of the result
    a = groups.select("lang", "source", "v", "p0")
    pairs = a.join(groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0")), "lang").where("source <> item")
    base = pairs.select("lang", "source", "item", F.when(F.col("v") > 0, F.col("v") * _gap(F.col("p0"), F.col("q0"))).otherwise(0).alias("value"))
    # a source's postings enter by their count alone
    counts = common.cut(scored.groupBy("lang", "source", "p").agg(F.count("*").alias("terms")), "counts")
    mine = counts.join(pairs, ["lang", "source"]).groupBy("lang", "source", "item").agg(F.sum(F.col("terms") * (_gap(F.col("p"), F.col("q0")) - _gap(F.col("p0"), F.col("q0")))).alias("value"))
    other = counts.withColumnRenamed("source", "item").join(pairs, ["lang", "item"]).groupBy("lang", "source", "item").agg(F.sum(F.col("terms") * (_gap(F.col("p0"), F.col("p")) - _gap(F.col("p0"), F.col("q0")))).alias("value"))
    # each term's sources in blocks, and a row for each two blocks; a language of few sources has one
    of_term = F.sum("n").over(Window.partitionBy("term", "lang"))
    blocks = F.ceil(F.col("sources") / BLOCK)
    block, each = F.pmod(F.xxhash64("source"), blocks).alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other")
    dealt = scored.withColumn("q", _per_mille(of_term, F.col("of_lang"), F.col("v"))).select("term", "lang", "source", "p", "p0", "q", block, each)
    dealt = dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    rows = dealt.groupBy("term", "lang", "i", "j").agg(F.collect_list(F.struct("block", "source", "p", "p0", "q")).alias("found")).where("i = j or size(found) > 1")
    both = common.cut(rows.mapInArrow(_compared(top), "lang string, source string, part string, item string, value long"), "compared")

    summed = base.unionByName(mine).unionByName(other).unionByName(both.where("part = 'pair'").drop("part")).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = summed.withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(order))
    terms = both.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.unionByName(terms).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(common.table(spark, sf_dir, "documents"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL = rf"""
with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as doc,
    regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as found from documents),
t as (select lang, source, doc, unnest(found) as term from d),
kept as (select lang, term from t group by lang, term having count(distinct doc) >= {LEAST_DOCS}),
post as (select lang, source, term, count(*)::hugeint as n from t semi join kept using (lang, term) group by all),
groups as (select distinct lang, source from d),
v as (select lang, count(*)::hugeint as v from kept group by lang),
total as (select lang, source, coalesce(sum(n), 0)::hugeint as total from groups left join post using (lang, source) group by all),
dense as (select k.lang, g.source, k.term, coalesce(p.n, 0) as n, 1 + {SCALE}::hugeint * (coalesce(p.n, 0) + 1) // (total + v) as p
  from kept k join groups g using (lang) join v using (lang) join total using (lang, source) left join post p using (lang, source, term)),
whole as (select lang, term, 1 + {SCALE}::hugeint * (sum(n)::hugeint + 1) // ((select sum(total)::hugeint from total x where x.lang = post.lang) + any_value(v)) as q
  from post join v using (lang) group by lang, term),
pair as (select a.lang, a.source, b.source as item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join dense x on x.lang = a.lang and x.source = a.source left join dense y on y.lang = b.lang and y.source = b.source and y.term = x.term
  group by all),
term as (select lang, source, term as item, ((p - q) * (p - q) // q)::bigint as value from dense join whole using (lang, term) where n > 0 and p > q)
select lang, source, 'pair' as part, item, value, (row_number() over (partition by lang, source order by value desc, item))::int as rank from pair
union all
select * from (select lang, source, 'term' as part, item, value, (row_number() over (partition by lang, source order by value desc, item))::int as rank from term) where rank <= {TOP}
"""
