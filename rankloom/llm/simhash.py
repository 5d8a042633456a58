"""SimHash near-duplicates by anchor-point covering.

Fingerprint: 64 bits over the XXH64 (seed 42) of three-word shingles, repeats counted. Two texts link when their
fingerprints differ in at most three bits.

Candidate search. A fingerprint is read as two halves of 32 bits; three differing bits leave one half with at most one
difference, so each half is searched for pairs at distance 1. The anchors of a half are the words of a covering code:
the perfect binary Golay code on 23 bits (covering radius 3) times the perfect Hamming code on 7 bits (covering radius
1), the last two bits left free: 65,536 anchors. A fingerprint has one home, the anchor nearest to it, and visits every
anchor within the covering radius plus the threshold: block by block that is a Golay word at distance at most 3 + 1 with
its own Hamming word, or its own Golay word with a Hamming word at distance at most 1 + 1. A neighbour's home is always
among them, so comparing, anchor by anchor, homes with homes and visitors finds every link. About eight copies of a
fingerprint are made for each half whatever the data.

Only distinct fingerprints are replicated, so exact copies cost one row. An anchor with many homes is dealt out in
blocks of homes, and its visitors stream past each block. From each run of comparisons only a star per group leaves,
never all pairs. Components come from alternating star contractions over written tables.

Defined results: null text is the empty text; without a word the fingerprint is zero and links like any other; rows with
a null id get a fingerprint and the smallest known id of their component, or null if it has none; repeated rows stay
repeated; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..shipping import ship
from . import common

THRESHOLD = 3
SHINGLE = 3
SEED = 42
#: Homes of one anchor that are compared in one block.
HOME_BLOCK = 8192
#: Comparisons held at once.
PAIR_BLOCK = 1 << 21

GOLAY_BITS, HAMMING_BITS = 23, 7
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the Golay code, x^3 + x + 1 the Hamming code.
GOLAY_POLY, HAMMING_POLY = 0b101011100011, 0b1011


def fingerprint(text: str | None) -> int:
    """The fingerprint of one text, unsigned."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist())]
    n, ones = len(hashes), np.zeros(64, np.int64)
    array = np.array(hashes, np.uint64)
    for at in range(0, n, 1 << 16):
        part = array[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id long, fp long): a fingerprint for every row of docs."""
    ship(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).mapInArrow(_fingerprint_batches, "id long, fp long")


def _syndromes(words: np.ndarray, poly: int, bits: int) -> np.ndarray:
    """Remainders of words, as polynomials over GF(2), modulo poly."""
    rest, degree = words.astype(np.uint32).copy(), poly.bit_length() - 1
    for k in range(bits - 1, degree - 1, -1):
        hit = (rest >> np.uint32(k)) & np.uint32(1)
        rest ^= hit * np.uint32(poly << (k - degree))
    return rest


@cache
def _patterns(poly: int, bits: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every syndrome its error pattern of weight at most radius, and all those of weight radius + 1 (ends, patterns)."""
    masks = np.arange(1 << bits, dtype=np.uint32) if bits <= 7 else _light(bits, radius + 1)
    weight, syndrome = np.bitwise_count(masks), _syndromes(masks, poly, bits)
    n = 1 << (poly.bit_length() - 1)
    leader = np.zeros(n, np.uint32)
    near = weight <= radius
    leader[syndrome[near]] = masks[near]
    far = weight == radius + 1
    order = np.argsort(syndrome[far], kind="stable")
    ends = np.concatenate(([0], np.cumsum(np.bincount(syndrome[far], minlength=n))))
    return leader, ends, masks[far][order]


def _light(bits: int, most: int) -> np.ndarray:
    """All words of so many bits with at most so many ones."""
    found = layer = np.zeros(1, np.uint32)
    for _ in range(most):
        grown = (layer[:, None] | (np.uint32(1) << np.arange(bits, dtype=np.uint32))[None, :]).ravel()
        layer = np.setdiff1d(np.unique(grown), found)
        found = np.union1d(found, layer)
    return found


def _expand(ends: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and pattern numbers of every (row, pattern of its syndrome)."""
    size = ends[key + 1] - ends[key]
    row = np.repeat(np.arange(len(key)), size)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(ends[key], size)


def anchors(fp: np.ndarray, visits: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, home): the home of each fingerprint in both halves and, if asked for, the anchors it visits."""
    rows, keys, homes = [], [], []
    g_mask, h_mask = np.uint32((1 << GOLAY_BITS) - 1), np.uint32((1 << HAMMING_BITS) - 1)
    g_near, g_ends, g_far = _patterns(GOLAY_POLY, GOLAY_BITS, 3)
    h_near, h_ends, h_far = _patterns(HAMMING_POLY, HAMMING_BITS, 1)
    for half in (0, 1):
        word = ((fp >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        g, h = word & g_mask, (word >> np.uint32(GOLAY_BITS)) & h_mask
        gs, hs = _syndromes(g, GOLAY_POLY, GOLAY_BITS), _syndromes(h, HAMMING_POLY, HAMMING_BITS)
        g0, h0 = g ^ g_near[gs], h ^ h_near[hs]
        parts = [(np.arange(len(fp)), g0, h0, True)]
        if visits:
            row, at = _expand(g_ends, gs)
            parts.append((row, g[row] ^ g_far[at], h0[row], False))
            row, at = _expand(h_ends, hs)
            parts.append((row, g0[row], h[row] ^ h_far[at], False))
        for row, a, b, home in parts:
            rows.append(row)
            keys.append((np.int64(half) << np.int64(32)) | (b.astype(np.int64) << np.int64(GOLAY_BITS)) | a.astype(np.int64))
            homes.append(np.full(len(row), home))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(homes)


def _home_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        _, key, _ = anchors(b.column(0).to_numpy().view(np.uint64), visits=False)
        yield pa.RecordBatch.from_arrays([pa.array(key)], ["anchor"])


def _placed(hot: dict[int, int]):
    """Rows (anchor, block, home, fp). hot: in how many blocks the homes of an anchor are dealt, where it is over one."""
    hot_keys = np.array(sorted(hot), np.int64)
    hot_n = np.array([hot[k] for k in sorted(hot)], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 8192):
                fp = whole.column(0).slice(at, 8192).to_numpy().view(np.uint64)
                row, key, home = anchors(fp)
                block = np.zeros(len(row), np.int64)
                if len(hot_keys):
                    i = np.minimum(np.searchsorted(hot_keys, key), len(hot_keys) - 1)
                    n = np.where(hot_keys[i] == key, hot_n[i], 1)
                    block = ((fp[row] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % n
                    copies = np.where(home, 1, n)
                    again = np.repeat(np.arange(len(row)), copies)
                    shift = np.arange(len(again)) - np.repeat(np.cumsum(copies) - copies, copies)
                    # a home is also compared with the homes of the other blocks, so it visits those
                    extra = np.repeat(np.flatnonzero(home & (n > 1)), n[home & (n > 1)])
                    extra_block = np.arange(len(extra)) - np.repeat(np.cumsum(n[home & (n > 1)]) - n[home & (n > 1)], n[home & (n > 1)])
                    other = extra_block != block[extra]
                    block = np.concatenate((np.where(home[again], block[again], shift), extra_block[other]))
                    row, key, home = (np.concatenate((x[again], x[extra][other])) for x in (row, key, home))
                    home[len(again) :] = False
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(block.astype(np.int32)), pa.array(home), pa.array(fp[row].view(np.int64))], ["anchor", "block", "home", "fp"])

    return run


def _groups(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of each node's component."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[u], label[v])
        was = label.copy()
        np.minimum.at(label, label[u], least)
        np.minimum.at(label, label[v], least)
        label = label[label]
        if np.array_equal(label, was):
            return label


def _stars(fp: np.ndarray, home: np.ndarray, group: np.ndarray, known: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Star edges of what links within groups; rows are sorted by group with homes first; the first `known` homes have been compared."""
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(group)])))
    of_home = np.flatnonzero(home)
    g = np.searchsorted(starts, of_home, "right") - 1
    first = np.where(of_home < known, known, of_home + 1)  # each home meets all that come after it
    size = starts[g] + sizes[g] - first
    us, vs, done, total = [], [], 0, np.cumsum(size)
    while done < len(of_home):
        base = total[done - 1] if done else 0
        upto = max(done + 1, int(np.searchsorted(total, base + PAIR_BLOCK, "right")))
        s = size[done:upto]
        u = np.repeat(of_home[done:upto], s)
        v = np.repeat(first[done:upto], s) + np.arange(len(u)) - np.repeat(np.cumsum(s) - s, s)
        hit = np.bitwise_count(fp[u] ^ fp[v]) <= THRESHOLD
        us.append(u[hit])
        vs.append(v[hit])
        if sum(map(len, us)) > PAIR_BLOCK:
            label = _groups(np.concatenate(us), np.concatenate(vs), len(fp))
            own = np.flatnonzero(label != np.arange(len(fp)))
            us, vs = [label[own]], [own]
        done = upto
    u, v = np.concatenate(us or [np.zeros(0, int)]), np.concatenate(vs or [np.zeros(0, int)])
    label = _groups(u, v, len(fp))
    own = np.flatnonzero(label != np.arange(len(fp)))
    return fp[label[own]], fp[own]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Star edges from rows sorted by (anchor, block, homes first); the homes of a group that goes on are carried over."""
    held_key, held = None, np.zeros(0, np.uint64)
    for b in batches:
        if not b.num_rows:
            continue
        anchor, block = b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.int64)
        home, fp = b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy().view(np.uint64)
        group = np.cumsum(np.concatenate(([0], (anchor[1:] != anchor[:-1]) | (block[1:] != block[:-1]))))
        first, last = (int(anchor[0]), int(block[0])), (int(anchor[-1]), int(block[-1]))
        known = len(held) if held_key == first else 0
        if known:
            fp, home, group = np.concatenate((held, fp)), np.concatenate((np.ones(len(held), bool), home)), np.concatenate((np.zeros(len(held), np.int64), group))
        u, v = _stars(fp, home, group, known)
        held_key, held = last, fp[(group == group[-1]) & home]
        u, v = u.view(np.int64), v.view(np.int64)
        other = u != v
        pairs = np.unique(np.stack((np.maximum(u, v)[other], np.minimum(u, v)[other])), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["u", "v"])


def links(fps: DataFrame) -> DataFrame:
    """(u long, v long), u > v: edges that connect just what linked fingerprints connect. fps: distinct fp long."""
    n_homes = fps.select("fp").mapInArrow(_home_batches, "anchor long").groupBy("anchor").count()
    hot = {r["anchor"]: -(-r["count"] // HOME_BLOCK) for r in n_homes.where(F.col("count") > HOME_BLOCK).collect()}  # at most 131,072 anchors
    placed = fps.select("fp").mapInArrow(_placed(hot), "anchor long, block int, home boolean, fp long")
    sorted_ = placed.repartition("anchor", "block").sortWithinPartitions("anchor", "block", F.desc("home"))
    return sorted_.mapInArrow(_compare, "u long, v long").distinct()


def components(edges: DataFrame, name: str = "stars") -> DataFrame:
    """(node long, root long): for each node of edges (u > v) the least node that it reaches, by alternating stars."""
    now, state = common.cut(edges.select("u", "v"), name), None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
        before, now = now, common.cut(small.distinct(), name)
        common.drop_cut(before)
        was, state = state, now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == was:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _rooted(prints: DataFrame) -> DataFrame:
    """(fp, least, root): of every distinct fingerprint its smallest id and its component."""
    fps = common.cut(prints.groupBy("fp").agg(F.min("id").alias("least")), "fps")
    roots = components(links(fps))
    return fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, fingerprint string, component_id long) for every row of docs; component_id: the smallest id reachable over links."""
    prints = common.cut(fingerprints(docs, id_col, text_col), "fp")
    rooted = _rooted(prints)
    heads = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(heads, "root").select("fp", "component_id")
    return prints.join(by_fp, "fp").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component: that with the smallest id (of repeated rows any one); without a known id in it any row."""
    prints = common.cut(fingerprints(docs, id_col, text_col), "fp")
    rooted = _rooted(prints)
    first = rooted.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "fp")).alias("m"))
    first = common.cut(first.select(F.col("m.fp").alias("fp"), F.col("m.least").alias("id")), "firsts")
    ident = docs[id_col].cast("long")
    if prints.groupBy("id").count().where("id is null or count > 1").isEmpty():
        # an id tells its row: the texts meet nothing but the ids that go
        gone = common.cut(prints.join(first, "id", "left_anti").select("id"), "gone")
        gone = gone.select(F.col("id").alias(common.spare_names(docs, 1)[0]))
        return docs.join(gone, ident == gone[gone.columns[0]], "left_anti")
    fp, key, none = common.spare_names(docs, 3)
    at = docs.columns.index(text_col)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.fromiter((fingerprint(t.as_py()) for t in b.column(at)), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found)], [*b.schema.names, fp])

    keys = lambda c: [F.coalesce(c, F.lit(0)).alias(key), c.isNull().alias(none)]
    marked = docs.mapInArrow(add, StructType([*docs.schema.fields, StructField(fp, LongType())]))
    # id and fingerprint together are the key of the join and of what follows it: one shuffle of the texts, and copies are spread by their ids
    kept = marked.select("*", *keys(F.col(id_col).cast("long"))).join(first.select(F.col("fp").alias(fp), *keys(F.col("id"))), [fp, key, none])
    return kept.dropDuplicates([fp, key, none]).select([F.col(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
