"""Mixing sources to target weights with hash-threshold histograms; DataFrame functions only.

A source's target is its share of a token budget by weight, held at a multiple of its own size; what is held back goes to
the others by weight until none is above. That water level is found by a few aggregates over the sources: those whose bound lies under
the level of the others are held, which raises the level, until no more are.

A source is then taken whole as often as its target allows, and the rest of the target is met by a threshold on a hash of
the document id. The threshold comes from nested histograms: tokens by (source, upper 12 hash bits), then, inside the one
bucket in which the budget runs out, by the next 12 bits, and inside that bucket by the hash itself. Where several rows share the hash
at the boundary, as rows that repeat an id do, the same is done once more inside it with a number of each row. Documents are
never sorted, and only hash, size and source are reread. The row at the boundary is taken if that brings the
source nearer to its target.

Defined results: null text has size 0; a null source is a source of its own, ordered last; rows with equal or null ids are rows of their
own, told apart at the boundary by their place in the table; an empty table gives an empty result; other columns are not looked
at by mix() and stay as they are in take().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.sampling import dense_ids
from . import common

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
SEED = "mix"
#: Hash bits: 60, read as buckets of 12, 12 and the rest; and 63 of a row's number.
UPPER, LOWER = 48, 36
ROW_LEVELS = (51, 39, 0)
ALL = (1 << 63) - 1


def _hash(ident: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(ident.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def _key(source: Column) -> Column:
    """In the order of the sources, null last."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("t"))


def targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(key, source_size, target) from (key, source_size), one row per source."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    ranked = sources.join(dense_ids(sources, "key", "rank"), "key")
    weighed = common.cut(ranked.select("key", "source_size", weight.alias("w"), (F.col("source_size") * cap).alias("most")), "mix-weights")
    budget = (weighed.agg(F.sum("source_size")).first()[0] or 0) * float(share)
    held, left, was = 0, weighed.agg(F.sum("w")).first()[0], None
    while left and (held, left) != was:  # each round holds more sources, in the end none more
        was = (held, left)
        under = F.col("most") * F.lit(left) < F.lit(budget - held) * F.col("w")
        held, left = weighed.agg(F.coalesce(F.sum(F.when(under, F.col("most"))), F.lit(0)), F.coalesce(F.sum(F.when(~under, F.col("w"))), F.lit(0))).first()
    most = F.col("most").cast("double")
    return weighed.select("key", "source_size", (F.least(most, F.lit(budget - held) * F.col("w") / F.lit(left)) if left else most).alias("target"))


def _boundary(histogram: DataFrame, by: str) -> DataFrame:
    """Of each key the first bucket in which the budget runs out; base: tokens before it."""
    upto = F.sum("tokens").over(Window.partitionBy("key").orderBy(by))
    crossing = histogram.withColumn("upto", F.col("base") + upto).where(F.col("upto") > F.col("rest"))
    return crossing.groupBy("key").agg(F.min(F.struct(by, (F.col("upto") - F.col("tokens")).alias("base"), "tokens")).alias("b")).select("key", F.col(f"b.{by}").alias(by), "b.base", F.col("b.tokens").alias("tokens"))


def plan(sized: DataFrame, **how) -> tuple[DataFrame, bool]:
    """((key, source_size, target, times, threshold, row_threshold) of each source, whether rows share a hash at a boundary).

    A source is taken whole `times` times, and once more up to the threshold: rows of a smaller hash, and of those with that hash the rows numbered up to row_threshold.
    """
    upper = common.cut(sized.groupBy("key", F.shiftright("h", UPPER).alias("upper")).agg(F.sum("size").alias("tokens")), "mix-upper")
    goal = targets(upper.groupBy("key").agg(F.sum("tokens").alias("source_size")), **how)
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = common.cut(goal.withColumn("times", times).withColumn("rest", F.col("target") - F.col("times") * F.col("source_size")), "mix-goal")
    budget = goal.where("source_size > 0 and rest > 0").select("key", "rest")
    one = _boundary(upper.join(budget, "key").withColumn("base", F.lit(0)), "upper").drop("tokens")
    inside = sized.select("key", F.shiftright("h", UPPER).alias("upper"), "h", "size").join(one, ["key", "upper"])
    inside = common.cut(inside.groupBy("key", "base", "h").agg(F.sum("size").alias("tokens"), F.count("*").alias("rows")), "mix-inside")
    lower = inside.groupBy("key", "base", F.shiftright("h", LOWER).alias("lower")).agg(F.sum("tokens").alias("tokens"))
    two = _boundary(lower.join(budget, "key"), "lower").drop("tokens")
    last = inside.drop("base").withColumn("lower", F.shiftright("h", LOWER)).join(two, ["key", "lower"])
    three = common.cut(_boundary(last.join(budget, "key"), "h"), "mix-three")
    nearer = lambda value: F.when(F.col("base") + F.col("tokens") - F.col("rest") < F.col("rest") - F.col("base"), value)
    shared = not three.join(inside.select("key", "h", "rows"), ["key", "h"]).where("rows > 1").isEmpty()
    if shared:
        tied = common.cut(sized.select("key", "h", "row", "size").join(three.select("key", "h", "base"), ["key", "h"]), "mix-tied")
        for shift in ROW_LEVELS:
            level = tied.withColumn("level", F.shiftright("row", shift))
            found = _boundary(level.groupBy("key", "base", "level").agg(F.sum("size").alias("tokens")).join(budget, "key"), "level")
            tied = level.drop("base").join(found.select("key", "level", "base"), ["key", "level"]).drop("level")
        rows = found.join(budget, "key").select("key", F.coalesce(nearer(F.col("level")), F.col("level") - 1).alias("row_threshold"))
    else:
        rows = three.join(budget, "key").select("key", F.coalesce(nearer(F.lit(ALL)), F.lit(-1)).alias("row_threshold"))
    made = goal.join(three.select("key", F.col("h").alias("threshold")), "key", "left").join(rows, "key", "left")
    return common.cut(made.select("key", "source_size", "target", "times", F.coalesce("threshold", F.lit(-1)).alias("threshold"), F.coalesce("row_threshold", F.lit(-1)).alias("row_threshold")), "mix-plan"), shared


def _row() -> Column:
    """A number of each row, spread evenly over 63 bits."""
    return F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 1)


def sizes(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", row: Column | None = None) -> DataFrame:
    return docs.select(docs[id_col].alias("doc_id"), _key(docs[source_col]).alias("key"), common.n_words(docs[text_col]).alias("size"), _hash(docs[id_col]).alias("h"), (_row() if row is None else row).alias("row"))


def _again(h: Column, row: Column, threshold: Column, row_threshold: Column) -> Column:
    return F.when((h < threshold) | ((h == threshold) & (row <= row_threshold)), 1).otherwise(0)


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of docs."""
    sized = common.cut(sizes(docs, id_col, source_col, text_col), "mix-sizes")
    again = _again(*map(F.col, ("h", "row", "threshold", "row_threshold")))
    return sized.join(plan(sized, **how)[0], "key").select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("times") + again)).alias("taken"))


def take(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """The mix itself: rows of docs, each as often as it is taken; documents without a word are left out."""
    own, spare = docs.columns, common.spare_names(docs, 7)
    made, shared = plan(common.cut(sizes(docs, id_col, source_col, text_col), "mix-sizes"), **how)
    row = F.lit(0)  # without a shared hash at a boundary all of its rows or none are taken
    if shared:  # rows need numbers that stay, so they are written with them
        docs = common.cut(docs.withColumn(spare[0], _row()), "mix-rows")
        row = docs[spare[0]]
        made, _ = plan(common.cut(sizes(docs, id_col, source_col, text_col, row), "mix-sizes"), **how)
    made = made.select([F.col(c).alias(n) for c, n in zip(("key", "times", "threshold", "row_threshold"), spare[1:])])
    key, times, threshold, row_threshold = (made[n] for n in spare[1:5])
    at = docs.join(made, _key(docs[source_col]) == key)
    copies = F.when(docs[text_col].rlike(common.WORD), times + _again(_hash(docs[id_col]), row, threshold, row_threshold)).otherwise(0).cast("int")
    repeated = at.withColumn(spare[5], F.explode(F.sequence(F.lit(0), copies)))  # 0 is no copy
    return repeated.where(F.col(spare[5]) > 0).select([docs[c] for c in own])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents"))


SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, '')), 1, 15))::bigint as h
  from documents
), s as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source is null, source) as rank
  from d group by source
), w as (
  select *, ([5, 2, 1])[((rank - 1) % 3 + 1)::int]::bigint as w, source_size * 2 as most, (sum(source_size) over ())::double * 1.5 as budget
  from s
), l as (
  select *, coalesce(sum(most) over (order by most / w, rank rows between unbounded preceding and 1 preceding), 0)::bigint as before,
         (sum(w) over (order by most / w, rank rows between current row and unbounded following))::bigint as weight_left
  from w
), f as (
  select before, weight_left from l where (budget - before) * w <= most * weight_left order by most / w, rank limit 1
), t as (
  select source, source_size, least(most::double, (budget - f.before) * w / f.weight_left) as target from l, f
), g as (
  select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as times from t
), r as (
  select *, target - times * source_size as rest from g
), h as (
  select source, h, sum(size)::bigint as tokens from d group by all
), c as (
  select h.source, h.h, h.tokens, sum(h.tokens) over (partition by h.source order by h.h) as upto, r.rest
  from h join r on h.source is not distinct from r.source where r.rest > 0
), b as (
  select source, h, upto - tokens as base, upto, rest from c where upto > rest
  qualify row_number() over (partition by source order by h) = 1
), p as (
  select r.*, coalesce(case when b.upto - b.rest < b.rest - b.base then b.h else b.h - 1 end, -1) as threshold
  from r left join b on r.source is not distinct from b.source
)
select d.doc_id, d.size, p.source_size, p.target, d.size * (p.times + case when d.h <= p.threshold then 1 else 0 end) as taken
from d join p on d.source is not distinct from p.source
"""
