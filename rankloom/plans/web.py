"""From web pages to answers: text, chunks, shortlist, re-ranking, prompts, cached generation, matching.

Every twentieth item of the benchmark is a question. Its accepted answers are its third and fourth words. Generator and hidden states are stand-ins: the generator
repeats the first words of the first document of its prompt, a chunk's hidden state is a row of the embeddings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as ft
from ..functions import vectors as fv
from ..operators import metrics, providers, ranking, shortlist
from ..sources.scratch import cut
from .base import DIR, E, V, query, r6, table, values, vectors
from .corpus import _HTML, _PACK, _SENTS
from .rerank import direction_row

MOST_WORDS, BLOCK, RECALL, HEAD = 40, 16, 12, 20
ALPHAS, SIZES = (0, 5), (2, 5)


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """(page_id, chunk, text) of all pages."""
    return table(spark, d, "pages").select("page_id", F.posexplode(ft.pack(ft.sentences(ft.html_text(F.col("html"))), MOST_WORDS)).alias("chunk", "text"))


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").where("item_id % 20 = 0").select("item_id", "text", F.array_distinct(ft.words(F.lower("text"))).alias("qw"))


def recalled(spark: SparkSession, d: str, m: int, rows: DataFrame | None = None) -> shortlist.Shortlist:
    """The m chunks of each question with most of its words."""
    asked = questions(spark, d).select(F.col("item_id").alias("q"), F.explode_outer("qw").alias("term"), F.lit(1).alias("weight"))
    rows = chunks(spark, d) if rows is None else rows
    return shortlist.shortlist(rows.withColumn("terms", F.split(F.lower("text"), " ")), ["page_id", "chunk"], F.struct("page_id", F.floor(F.col("chunk") / BLOCK)), F.col("terms"), asked, m)


_RECALL = f"""src as (select page_id as id, {_HTML} as t from pages), {_PACK.format(sents=_SENTS.format(t='t'), most=MOST_WORDS)},
q as (select item_id, text as question, list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')) as qw, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '') as ws from benchmark where item_id % 20 = 0),
sc as (select item_id, question, qw, ws, id, chunk, text, len(list_intersect(qw, list_distinct(string_split(lower(text), ' '))))::double / len(qw) as s from ch, q),
top as (select *, row_number() over (partition by item_id order by round(s, 9) desc, id, chunk) as pos from sc qualify pos <= {{m}})"""
_HEAD = "array_to_string(list_filter(string_split({t}, ' '), lambda w: w <> '')[1:{n}], ' ')"


@query("html_shortlist", f"with recursive {_RECALL.format(m=5)} select item_id, id as page_id, chunk, round(s, 6) as score, pos, md5({_HEAD.format(t='text', n=HEAD)}) as head from top")
def html_shortlist(spark, d):
    all_chunks = cut(chunks(spark, d), "chunks")
    top = recalled(spark, d, 5, all_chunks).top.withColumnRenamed("q", "item_id").join(questions(spark, d).select("item_id", F.size("qw").alias("n")), "item_id")
    rows = top.join(all_chunks, ["page_id", "chunk"])
    return rows.select("item_id", "page_id", "chunk", r6(F.col("score") / F.col("n")).alias("score"), F.col("pos").cast("long").alias("pos"), F.md5(ft.head_words(F.col("text"), HEAD)).alias("head"))


def reranked(spark: SparkSession, d: str) -> DataFrame:
    """(item_id, alpha10, pos, page_id, chunk, text): the shortlist of each question under each weight, chunks cut to HEAD words."""
    all_chunks = cut(chunks(spark, d), "chunks")
    top = recalled(spark, d, RECALL, all_chunks).top.withColumnRenamed("q", "item_id").drop("pos")
    rows = top.join(all_chunks, ["page_id", "chunk"])
    v = vectors(spark, d)
    projected = v.crossJoin(F.broadcast(direction_row(v))).select("vec_id", fv.dot(F.col("vec"), F.col("dir")).alias("proj"))  # one direction
    n = v.agg(F.count("*").alias("__n"))
    rows = rows.crossJoin(F.broadcast(n)).withColumn("vec_id", (F.col("page_id") * 7 + F.col("chunk")) % F.col("__n")).drop("__n")  # one row
    rows = rows.join(projected, "vec_id", "left").withColumns({"proj": F.coalesce("proj", F.lit(0.0)), "score": F.col("score").cast("double")})
    for value, out in (("score", "zc"), ("proj", "zp")):
        rows = ranking.zscore(rows, value, ["item_id"], out, "zero")
    grid = rows.crossJoin(F.broadcast(values(spark, ALPHAS, "alpha10 int")))
    grid = grid.withColumns({"s": ranking.fuse(F.col("zc"), F.col("zp"), F.col("alpha10") / 10.0), "place": F.struct("page_id", "chunk")})
    placed = grid.withColumn("pos", ranking.position(["item_id", "alpha10"], "s", "place"))  # RECALL rows a group
    return placed.select("item_id", "alpha10", "pos", "page_id", "chunk", ft.head_words(F.col("text"), HEAD).alias("text"))


def first_words(prompts: list[str]) -> list[str]:
    """Stand-in for a generator: the first eight words of the first document."""
    return [" ".join(p.split("\n")[1][4:].split(" ")[:8]) if p.count("\n") > 1 else "" for p in prompts]


def answered(spark: SparkSession, d: str) -> DataFrame:
    """(item_id, alpha10, k, key, answer, cached, correct). What was generated for the first weight is the cache of the others."""
    rows = reranked(spark, d).withColumn("k", F.explode(F.array(*map(F.lit, SIZES)))).where("pos <= k")
    listed = rows.groupBy("item_id", "alpha10", "k").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("docs"))  # k texts
    asked = listed.join(questions(spark, d).select("item_id", F.col("text").alias("question"), F.slice(ft.words(F.lower("text")), 3, 2).alias("golds")), "item_id")
    jobs = cut(asked.select("item_id", "alpha10", "k", "golds", ft.prompt(F.col("docs"), F.col("question")).alias("prompt")).withColumn("key", F.sha2("prompt", 256)), "jobs")
    first = jobs.where(F.col("alpha10") == ALPHAS[0]).select("prompt")
    cache = cut(providers.per_text(first, "prompt", first_words, "answer", "string"), "generations")
    out = providers.generate(jobs, "prompt", first_words, cache)
    known = cache.select(F.sha2("prompt", 256).alias("key"), F.lit(True).alias("cached")).distinct()
    out = out.join(known, "key", "left").withColumn("cached", F.coalesce("cached", F.lit(False)))
    return out.select("item_id", "alpha10", "k", "key", "answer", "cached", ft.matches_bounded(F.col("answer"), F.col("golds")).alias("correct"))


_WEB = f"""{_RECALL.format(m=RECALL)}, {V}, {E}, {DIR}, pr as (select vec_id, list_dot_product(vec, dir) as proj from v, dir),
z as (select item_id, question, ws, id, chunk, text, len(list_intersect(qw, list_distinct(string_split(lower(text), ' '))))::double as c, coalesce(proj, 0) as p from top left join pr on vec_id = (id * 7 + chunk) % (select count(*) from v)),
f as (select *, case when stddev_pop(c) over w < 1e-12 then 0 else (c - avg(c) over w) / stddev_pop(c) over w end as zc, case when stddev_pop(p) over w < 1e-12 then 0 else (p - avg(p) over w) / stddev_pop(p) over w end as zp from z window w as (partition by item_id)),
a(alpha10) as (values (0), (5)), rk as (select *, row_number() over (partition by item_id, alpha10 order by round((1 - alpha10::double / 10) * zc + alpha10::double / 10 * zp, 9) desc, id, chunk) as pos, {_HEAD.format(t='text', n=HEAD)} as head from f, a),
k(k) as (values (2), (5)),
pm as (select item_id, alpha10, k, any_value(ws[3:4]) as golds, 'Documents:' || chr(10) || string_agg('[' || pos || '] ' || head, chr(10) order by pos) || chr(10) || chr(10) || 'Question: ' || any_value(question) || chr(10) || 'Answer:' as prompt, any_value(head) filter (where pos = 1) as first from rk, k where pos <= k group by item_id, alpha10, k),
an as (select item_id, alpha10, k, golds, sha256(prompt) as key, {_HEAD.format(t='first', n=8)} as answer, prompt in (select prompt from pm where alpha10 = 0) as cached from pm),
ok as (select *, trim(regexp_replace(lower(answer), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) as a from an),
rs as (select item_id, alpha10, k, key, answer, cached, len(list_filter(golds, lambda g: case when length(g) < 4 or regexp_matches(g, '^[0-9.,]+$') then regexp_matches(a, '(^|[^a-z0-9_])' || regexp_escape(g) || '($|[^a-z0-9_])') else contains(a, g) end)) > 0 as correct from ok)"""


@query("web_answers", f"with recursive {_WEB} select * from rs")
def web_answers(spark, d):
    return answered(spark, d)


@query("web_answer_accuracy", f"with recursive {_WEB} select alpha10, k, round(avg(correct::int), 6) as accuracy, count(*) as n, count(distinct key) as prompts, count(distinct key) filter (where cached) as cached from rs group by alpha10, k")
def web_answer_accuracy(spark, d):
    a = answered(spark, d)
    return a.groupBy("alpha10", "k").agg(r6(metrics.rate(F.col("correct"))).alias("accuracy"), F.count("*").alias("n"), F.count_distinct("key").alias("prompts"), F.count_distinct(F.when(F.col("cached"), F.col("key"))).alias("cached"))
