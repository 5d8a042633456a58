"""The trie of conversation prefixes by partition refinement.

Conversations are numbered turn by turn from a range partitioning, rebuilt, and copies collapse into one weighted sequence, told by two 64-bit
hashes of all turns, so a conversation that thousands repeat is one row a turn from there on. All sequences start in one class, the root. A round
takes the active sequences some turns further (FIRST, then twice as many each round, up to MOST) and splits their classes at each of those turns;
a class is named by its depth and a 128-bit hash of the turns that lead to it. A sequence that is alone in its class retires: the rest of it is a
unary chain, which is emitted without any further round. Folding back, each node's own tokens go to its smallest member; sums along a sequence,
from its end, added up over a class's members, are the sums of the node's subtree. Texts leave after the numbering; only their hashes and sizes go
through the rounds. No conversation and no class is held by one task: long chains are summed in blocks, members of one class are aggregated.

Defined results: rows without conv_id belong to no conversation and are left out; null role and text are empty; a null turn comes first; turns of
equal number are ordered by role, then text, repeated rows stay repeated; a conversation whose rebuilt form has no turns is a member of the root; an empty
table has no nodes; only the named columns are looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship
from . import common

#: Turns of the first round, and of any.
FIRST, MOST = 2, 256
#: Turns that are summed together in a chain, and ids of one piece of a digest's input.
BLOCK, IDS = 4096, 65_536
EMPTY = hashlib.sha256(b"").hexdigest()
#: The rebuilding rule: the base of c is c - c % FAMILY, and the first crc32(c) % HEADS turns come from it.
FAMILY, HEADS = 5, 9


def numbered(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos, k1, k2, bytes): the place of every turn from 1, two hashes of role and text, and the bytes of the text."""
    role, text = (F.coalesce(turns[c].cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.select(turns[conv_col].cast("long").alias("conv"), turns[turn_col].cast("long").alias("turn"), role.alias("role"), text.alias("text")).where("conv is not null")
    # the range goes by prefixes, as its bounds are sampled to the driver; they are in the same order as the whole
    short = F.length("role") <= 64
    ranged = rows.repartitionByRange("conv", "turn", F.substring("role", 1, 64), ~short, F.when(short, F.substring("text", 1, 64)))
    ranged = ranged.sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "text")
    hashed = ranged.select("conv", F.xxhash64(F.lit(1), "role", "text").alias("k1"), F.xxhash64(F.lit(2), "text", "role").alias("k2"), F.octet_length("text").cast("long").alias("bytes"), F.monotonically_increasing_id().alias("at"))
    slim = common.cut(hashed.withColumn("part", F.shiftright("at", 33)), "turns")
    parts = slim.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("conv", "part", (before - F.col("first") + 1).alias("start"))
    return slim.join(starts, ["conv", "part"]).select("conv", (F.col("at") + F.col("start")).alias("pos"), "k1", "k2", "bytes")


def head(conv: Column) -> Column:
    return (F.crc32(conv.cast("string").cast("binary")) % HEADS).cast("long")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations' turns, numbered as before, and (conv, turns) of every conversation."""
    own = turns.groupBy("conv").agg(F.max("pos").alias("n")).withColumn("h", head(F.col("conv"))).withColumn("base", F.col("conv") - F.col("conv") % FAMILY)
    bases = own.select(F.col("conv").alias("base"), F.col("n").alias("of_base"))
    convs = own.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("of_base", F.lit(0))))
    convs = common.cut(convs.select("conv", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("turns")), "conversations")
    heads = turns.where(F.col("pos") < HEADS).withColumnRenamed("conv", "base").join(convs, "base").where("pos <= taken")
    tails = turns.join(convs, "conv").where("pos > h").withColumn("pos", F.col("pos") - F.col("h") + F.col("taken"))
    columns = ["conv", "pos", "k1", "k2", "bytes"]
    rows = heads.select(columns).unionByName(tails.select(columns))
    # a turn's hashes with its place; those of a prefix are their exclusive or
    x = [F.xxhash64(F.lit(k), "pos", "k1", "k2").alias(f"x{k}") for k in (3, 4)]
    return rows.select("conv", "pos", "bytes", *x), convs.select("conv", "turns")


def _id_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Comma-joined runs of sorted ids, IDS of one group at most in each."""
    names = ["f1", "f2", "turns", "first", "ids"]

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (*key, ids[0])] + [pa.array([",".join(map(str, ids))])], names)

    key, ids = None, []
    for b in batches:
        for *of, conv in zip(*(b.column(c).to_pylist() for c in ("f1", "f2", "turns", "conv"))):
            if ids and (of != key or len(ids) >= IDS):
                yield told()
                ids = []
            key = of
            ids.append(conv)
    if ids:
        yield told()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["f1", "f2", "turns", "ends"]
    key, sha = None, None

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in key] + [pa.array([sha.hexdigest()])], names)

    for b in batches:
        for *of, ids in zip(*(b.column(c).to_pylist() for c in ("f1", "f2", "turns", "ids"))):
            if of != key:
                if key:
                    yield told()
                key, sha = of, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
    if key:
        yield told()


def sequences(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(seq, w, turns, ends) of each distinct sequence: its smallest conversation, how many have it, its turns, and the digest of their ids."""
    prints = rows.groupBy("conv").agg(F.bit_xor("x3").alias("f1"), F.bit_xor("x4").alias("f2"))
    whole = common.cut(convs.join(prints, "conv", "left").na.fill(0, ["f1", "f2"]), "prints")
    key = ["f1", "f2", "turns"]
    seqs = common.cut(whole.groupBy(key).agg(F.min("conv").alias("seq"), F.count("*").alias("w")), "sequences")
    # the ids of one sequence are sorted by many tasks; the last step goes through their joined text, a piece at a time
    copies = whole.join(seqs.where("w > 1").select(key), key).select(*key, "conv").repartitionByRange(*key, "conv").sortWithinPartitions(*key, "conv")
    pieces = copies.mapInArrow(_id_pieces, "f1 long, f2 long, turns long, first long, ids string")
    ends = pieces.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(_digests, "f1 long, f2 long, turns long, ends string")
    return common.cut(seqs.join(ends, key, "left").select("seq", "w", "turns", F.coalesce("ends", F.sha2(F.col("seq").cast("string"), 256)).alias("ends")), "weighted")


def refine(rows: DataFrame, seqs: DataFrame, first: int = FIRST, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(seq, depth, p1, p2, q1, q2, bytes) of every active sequence in its class, q being the class before; (seq, alone): the depth from which it is alone.

    rows: (seq, depth, x3, x4, bytes), depth 0 among them.
    """
    depth, width = -1, first + 1
    active = seqs.select("seq", F.lit(0).cast("long").alias("c1"), F.lit(0).cast("long").alias("c2"))
    steps, retired = [], []
    while True:
        along = Window.partitionBy("seq").orderBy("depth")
        here = rows.where(F.col("depth").between(depth + 1, depth + width)).join(active, "seq")
        for k, x in (("1", "x3"), ("2", "x4")):
            here = here.withColumn(f"p{k}", F.bit_xor(x).over(along).bitwiseXOR(F.col(f"c{k}"))).withColumn(f"q{k}", F.col(f"p{k}").bitwiseXOR(F.col(x)))
        step = common.cut(here.select("seq", "depth", "p1", "p2", "q1", "q2", "bytes"), "step")
        classes = step.groupBy("depth", "p1", "p2").agg(F.count("*").alias("n"), F.min("seq").alias("seq"))
        alone = common.cut(classes.where("n = 1").groupBy("seq").agg(F.min("depth").alias("alone")), "alone")
        steps.append(step)
        retired.append(alone)
        depth, width = depth + width, min(2 * (width - (depth < 0)), most)
        active = step.where(F.col("depth") == depth).join(alone, "seq", "left_anti").select("seq", F.col("p1").alias("c1"), F.col("p2").alias("c2"))
        if active.isEmpty():
            break
    return reduce(DataFrame.unionByName, steps), reduce(DataFrame.unionByName, retired)


def _from_the_end(df: DataFrame, value: str, out: str) -> DataFrame:
    """Sums of value over a sequence's rows from each depth on, in blocks."""
    block = F.floor(F.col("depth") / BLOCK).alias("block")
    within = Window.partitionBy("seq", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("seq").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    df = df.select("*", block).withColumn(out, F.sum(value).over(within))
    rest = df.groupBy("seq", "block").agg(F.sum(value).alias("s")).select("seq", "block", F.coalesce(F.sum("s").over(after), F.lit(0)).alias("rest"))
    return df.join(rest, ["seq", "block"]).withColumn(out, F.col(out) + F.col("rest")).drop("block", "rest")


def trie(turns: DataFrame, **columns) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    ship(turns.sparkSession)
    rows, convs = rebuilt(numbered(turns, **columns))
    rows = common.cut(rows, "rebuilt")
    seqs = sequences(rows, convs)
    root = seqs.select("seq", F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(c) for c in ("bytes", "x3", "x4")])
    rows = common.cut(rows.withColumnsRenamed({"conv": "seq", "pos": "depth"}).join(seqs.select("seq"), "seq", "left_semi").unionByName(root), "of_sequences")
    steps, alone = refine(rows, seqs)
    seqs = common.cut(seqs.join(alone, "seq", "left").withColumn("alone", F.coalesce("alone", F.col("turns") + 1)), "retired")

    # chains: what a sequence has for itself
    chains = rows.drop("x3", "x4").join(seqs.where("alone <= turns"), "seq").where("depth >= alone").withColumn("own", (F.col("w") - 1) * F.col("bytes"))
    chains = common.cut(_from_the_end(chains, "own", "saved"), "chains")

    # shared nodes: sums from the end along each sequence, then over the members of each class
    shared = steps.join(seqs, "seq").where("depth < alone")
    shared = common.cut(shared, "shared")
    node = ["depth", "p1", "p2"]
    classes = shared.groupBy(node).agg(F.sum("w").alias("n_convs"), F.min("seq").alias("conv_id"), F.first("bytes").alias("bytes"), F.first("q1").alias("q1"), F.first("q2").alias("q2"))
    classes = common.cut(classes, "classes")
    # a class's own tokens are counted once, with its smallest member
    own = classes.select(F.col("conv_id").alias("seq"), "depth", ((F.col("n_convs") - 1) * F.col("bytes")).alias("own"))
    ended = chains.where("depth = alone").select("seq", "depth", F.col("saved").alias("own"))
    leaf = F.when(F.col("alone") <= F.col("turns"), 1).otherwise(0)
    along = shared.select("seq", *node, leaf.alias("leaf"), F.when(F.col("depth") == F.col("turns"), F.col("ends")).alias("ends"))
    along = along.join(own.unionByName(ended), ["seq", "depth"], "full").na.fill(0, ["own"])
    folded = _from_the_end(along, "own", "saved").where("p1 is not null").groupBy(node).agg(F.sum("saved").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"), F.max("ends").alias("ends"))

    # heads of chains and shared nodes hang on shared nodes
    heads = chains.where("depth = alone").select("seq", "depth").join(steps.select("seq", "depth", "q1", "q2"), ["seq", "depth"])
    below = heads.select("depth", "q1", "q2").unionByName(classes.select("depth", "q1", "q2")).where("depth > 0")
    children = below.groupBy("depth", "q1", "q2").agg(F.count("*").alias("n_children")).select((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2"), "n_children")
    parents = classes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    nodes = classes.join(folded, node).join(children, node, "left").join(parents, ["depth", "q1", "q2"], "left")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    nodes = nodes.withColumn("ends_sha256", F.coalesce("ends", F.lit(EMPTY))).na.fill(0, ["n_children"]).select(columns)
    above = heads.join(parents, ["depth", "q1", "q2"]).select("seq", "depth", "parent_conv_id")
    alone_nodes = chains.join(above, ["seq", "depth"], "left").select(
        F.col("seq").alias("conv_id"),
        "depth",
        F.coalesce("parent_conv_id", F.when(F.col("depth") > F.col("alone"), F.col("seq"))).alias("parent_conv_id"),
        F.col("w").alias("n_convs"),
        F.when(F.col("depth") < F.col("turns"), 1).otherwise(0).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.when(F.col("depth") == F.col("turns"), F.col("ends")).otherwise(EMPTY).alias("ends_sha256"),
    )
    return nodes.unionByName(alone_nodes)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(common.table(spark, sf_dir, "conversations"))


#: crc32 in DuckDB: each byte is folded in, then eight steps of the reflected polynomial, marked by -1.
_CRC = """xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(conv_id::varchar, ''), lambda c: list_concat([ord(c)::bigint], [-1, -1, -1, -1, -1, -1, -1, -1])))),
    lambda a, b: case when b >= 0 then xor(a, b) else xor(a >> 1, 3988292384 * (a & 1)) end), 4294967295)"""
SQL = f"""
with t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, role, text) as pos, role, text
    from (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null)),
c as (select conv_id, {_CRC} % {HEADS} as h, conv_id - conv_id % {FAMILY} as base from (select distinct conv_id from t)),
taken as (select c.conv_id, h, least(h, (select count(*) from t where t.conv_id = c.base)) as k, base from c),
r as (select taken.conv_id, pos, role, text from taken join t on t.conv_id = taken.base and pos <= h
    union all select taken.conv_id, pos - h + k, role, text from taken join t on t.conv_id = taken.conv_id and pos > h),
l as (select conv_id, coalesce(list(struct_pack(role := role, text := text) order by pos) filter (pos is not null), []) as turns from c left join r using (conv_id) group by conv_id),
path as (select conv_id, d, d = len(turns) as ends, d, min(conv_id) over (partition by d, list_slice(turns, 1, d)) as node, case when d > 0 then strlen(turns[d].text) else 0 end as bytes
    from (select conv_id, turns, unnest(range(0, len(turns) + 1)) as d from l)),
nodes as (select node, d, count(*) as n_convs, any_value(bytes) as bytes, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '')) as ends_sha256 from path group by node, d),
up as (select n.*, p.node as parent from nodes n left join path p on p.conv_id = n.node and p.d = n.d - 1),
kids as (select parent as node, d - 1 as d, count(*) as n_children from up where d > 0 group by all),
own as (select n.*, coalesce(n_children, 0) as n_children from up n left join kids k using (node, d)),
below as (select p.node, p.d, sum((n_convs - 1) * y.bytes) as saved, count(*) filter (y.n_children = 0) as n_leaves from own y join path p on p.conv_id = y.node and p.d <= y.d group by all)
select node as conv_id, d::bigint as depth, parent as parent_conv_id, n_convs, n_children, n_leaves, saved::bigint as saved_tokens, ends_sha256 from own join below using (node, d)
"""
