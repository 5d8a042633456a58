"""End to end: re-rank, put the first k documents into a prompt, generate an answer, match it.

A vector's text is the document of the same id; a query asks for its own document. Documents without a text count as empty. Answers
come from a stand-in for the generator and so do the accepted ones: an answer is right if it holds the first digit of the md5 of the query's text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as ft
from ..operators import metrics, providers, rerank
from ..sources import scratch
from .base import ALPHAS, query, r6, rounded, table, vectors
from .rerank import MIXED_TOP, RES, asked, grid_directions, mixture_top

LAYER = 1
SIZES = (2, 5)


def _answers_sql(by: str) -> str:
    return f"""sizes(k) as (values (2), (5)),
ctx as (select {by}, alpha10, q, k, string_agg('[' || pos || '] ' || coalesce(text, ''), chr(10) order by pos) as ctx from tp left join documents on doc_id = id, sizes where pos <= k group by all),
an as (select {by}, alpha10, k, text, 'answer ' || substr(sha256(concat('Documents:', chr(10), ctx, chr(10), chr(10), 'Question: ', lang, '?', chr(10), 'Answer:')), 1, 8) as answer from ctx join documents on doc_id = q),
ok as (select {by}, alpha10, k, contains(answer, substr(md5(text), 1, 1)) as ok from an)"""


def answers(spark: SparkSession, d: str, top: DataFrame, by: str) -> DataFrame:
    """(by, alpha10, k, ok) from the first documents (by, alpha10, q, pos, id).

    The grid is shuffled as digests of texts only. Each distinct prompt, a language and texts in order, is built and answered once, at the smallest query that
    asks it, and each such query fetches each of its texts once; prompts themselves are never shuffled.
    """
    ends = top.agg(F.min(F.least("q", "id")), F.max(F.greatest("q", "id"))).first()
    docs = table(spark, d, "documents").where(F.col("doc_id").between(*ends))
    key = lambda text: F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))
    known = scratch.cut(docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.substring(F.md5("text"), 1, 1).alias("digit"), key(F.col("text")).alias("key")), "known")
    listed = top.join(known.select(F.col("doc_id").alias("id"), "key"), "id", "left").groupBy(by, "alpha10", "q").agg(F.collect_list(F.struct("pos", F.coalesce("key", key(F.lit(""))).alias("key"))).alias("all"))  # 5 a group
    sized = listed.join(known.select(F.col("doc_id").alias("q"), "lang", "digit"), "q").withColumn("k", F.explode(F.array(*map(F.lit, SIZES))))
    grid = scratch.cut(sized.withColumn("keys", F.transform(F.filter(F.array_sort("all"), lambda x: x["pos"] <= F.col("k")), lambda x: x["key"])).drop("all"), "grid")
    asks = grid.groupBy("lang", "keys").agg(F.min("q").alias("q")).groupBy("q").agg(F.collect_list(F.struct("lang", "keys")).alias("asks"))  # no more than the grid has
    one_of_each = known.where(F.col("key") != key(F.lit(""))).groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    needed = asks.select("q", F.explode(F.array_distinct(F.flatten("asks.keys"))).alias("key")).join(one_of_each, "key")
    # files may be small where texts are alike, but texts are too large to be sent to every executor
    found = needed.join(docs.select("doc_id", "text").hint("merge"), "doc_id").where(key(F.col("text")) == F.col("key"))
    texts = found.groupBy("q").agg(F.collect_list(F.struct("key", "text")).alias("texts")).hint("merge")
    text_of = lambda k: F.coalesce(F.get(F.filter("texts", lambda t: t["key"] == k), F.lit(0))["text"], F.lit(""))
    made = F.transform("asks", lambda a: F.struct(a["lang"].alias("lang"), a["keys"].alias("keys"), ft.prompt(F.transform(a["keys"], text_of), F.concat(a["lang"], F.lit("?"))).alias("prompt")))
    answered = providers.each(asks.join(texts, "q", "left").select(F.inline(made)), "prompt", providers.echo_digest, "answer", "string")
    return grid.join(answered, ["lang", "keys"]).select(by, "alpha10", "k", ft.matches_any(F.col("answer"), F.array("digit")).alias("ok"))


GRID_SQL = f"""{RES}, tp as (select seed, alpha10, q, id, row_number() over (partition by seed, alpha10, q order by s desc, id) as pos from sc where layer = {LAYER} qualify pos <= 5), {_answers_sql("seed")}"""
MIXED_SQL = f"{MIXED_TOP}, {_answers_sql('combo')}"


def seeded_answers(spark: SparkSession, d: str) -> DataFrame:
    """(seed, alpha10, k, ok) for the directions of one layer."""
    v = vectors(spark, d)
    dirs = {seed: x for (seed, layer), x in grid_directions(spark, v).items() if layer == LAYER}
    top = rerank.fused_top(v, asked(v), list(dirs.values()), ALPHAS, max(SIZES))
    return answers(spark, d, top.withColumn("seed", F.element_at(F.array(*map(F.lit, dirs)), F.col("dir") + 1)), "seed")


@query("end_to_end_accuracy", f"with {GRID_SQL} select seed, alpha10, k, round(avg(ok::int), 6) as accuracy, count(*) as n from ok group by all")
def end_to_end_accuracy(spark, d):
    return seeded_answers(spark, d).groupBy("seed", "alpha10", "k").agg(r6(metrics.rate(F.col("ok"))).alias("accuracy"), F.count("*").alias("n"))


@query("end_to_end_curve", f"with {GRID_SQL}, acc as (select seed, alpha10, k, avg(ok::int) as acc from ok group by all) select alpha10, k, round(avg(acc), 6) as mean, round(coalesce(stddev_samp(acc), 0), 6) as std from acc group by alpha10, k")
def end_to_end_curve(spark, d):
    s = seeded_answers(spark, d).groupBy("seed", "alpha10", "k").agg(metrics.rate(F.col("ok")).alias("acc"))
    return metrics.over_seeds(s, ["alpha10", "k"], ["acc"]).select("alpha10", "k", r6("acc_mean").alias("mean"), r6("acc_std").alias("std"))


@query(
    "mixture_end_to_end",
    f"""with {MIXED_SQL}, acc as (select combo, alpha10, k, avg(ok::int) as acc from ok group by all), st as (select min(alpha10) filter (where alpha10 > 0) as first from acc)
select combo, k, alpha10, round(acc, 6) as acc, round(acc - max(acc) filter (where alpha10 = 0) over (partition by combo, k), 6) as delta, alpha10 = first as steered from acc, st""",
)
def mixture_end_to_end(spark, d):
    c = answers(spark, d, mixture_top(spark, d), "combo").groupBy("combo", "alpha10", "k").agg(metrics.rate(F.col("ok")).alias("acc"))
    first = c.agg(F.min(F.when(F.col("alpha10") > 0, F.col("alpha10"))).alias("a"))
    out = c.withColumn("delta", F.col("acc") - metrics.baseline("acc", ["combo", "k"])).crossJoin(F.broadcast(first))  # one row
    return rounded(out.select("combo", "k", "alpha10", "acc", "delta", (F.col("alpha10") == F.col("a")).alias("steered")), "acc", "delta")
