"""Whole comparisons: two runs of the grid with ten metrics, answers under prompt conditions, and re-ranking by a judge."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as ft
from ..operators import metrics, providers, rerank
from ..sources import scratch, store
from .base import ALPHAS, KS, LAYERS, query, rounded, table, vectors
from .rerank import RATES, REC, _simple_sql, asked, grid_records
from .web import first_words

# ---- two runs of the grid ---------------------------------------------------------------------------------------

OLD, NEW = 42, 67
#: What a row is compared by, from the rates at k and the mean ranks of a run.
METRICS = {
    "gold_recall_at_k": "gold_rate",
    "nonfactual_rate_at_k": "nf_rate",
    "gold_lift": "gold_rate - gold_rate0",
    "nf_drop": "nf_rate0 - nf_rate",
    "layer_score": "gold_rate - gold_rate0 + (nf_rate0 - nf_rate)",
    "mean_gold_rank": "gold_rank",
    "mean_nf_rank": "nf_rank",
    "gold_rank_gain": "gold_rank0 - gold_rank",
    "nf_rank_change": "nf_rank0 - nf_rank",
    "rank_separation_gain": "gold_rank0 - gold_rank - (nf_rank0 - nf_rank)",
}
KEYS = ["layer", "alpha10", "k"]
WIDE = [f"{p}_{m}" for m in METRICS for p in ("old", "new", "delta")]


def run_metrics(records: DataFrame) -> DataFrame:
    """(seed, layer, alpha10, k, the ten metrics) of records (seed, layer, alpha10, q, gold_rank, nf_rank); gains are over alpha 0 of the same run, layer and k."""
    rates = metrics.hit_rates(records, ["seed", "layer", "alpha10"], list(KS)).drop("n")
    both = rates.join(metrics.mean_ranks(records, ["seed", "layer", "alpha10"]), ["seed", "layer", "alpha10"])
    both = both.withColumns({f"{c}0": metrics.baseline(c, ["seed", "layer", "k"]) for c in ("gold_rate", "nf_rate", "gold_rank", "nf_rank")})
    return both.select("seed", *KEYS, *[F.expr(e).alias(m) for m, e in METRICS.items()])


def compare(new: DataFrame, old: DataFrame) -> DataFrame:
    """The new run's rows with those of the old one and the differences; null, and has_old false, where there is no old row."""
    n = new.select(*KEYS, *[F.col(m).alias(f"new_{m}") for m in METRICS])
    o = old.select(*KEYS, F.lit(True).alias("has_old"), *[F.col(m).alias(f"old_{m}") for m in METRICS])
    both = n.join(o, KEYS, "left").withColumn("has_old", F.coalesce("has_old", F.lit(False)))
    return both.withColumns({f"delta_{m}": F.col(f"new_{m}") - F.col(f"old_{m}") for m in METRICS}).select(*KEYS, "has_old", *WIDE)


_RUNS = f"""{RATES}, rk as (select seed, layer, alpha10, avg(gold_rank) as gold_rank, avg(nf_rank) as nf_rank from res group by all),
bs as (select seed, layer, alpha10, k, gold_rate, nf_rate, gold_rank, nf_rank, {", ".join(f"max({c}) filter (where alpha10 = 0) over w as {c}0" for c in ("gold_rate", "nf_rate", "gold_rank", "nf_rank"))}
  from rates join rk using (seed, layer, alpha10) window w as (partition by seed, layer, k)),
mt as (select seed, layer, alpha10, k, {", ".join(f"{e} as {m}" for m, e in METRICS.items())} from bs),
cp as (select n.layer, n.alpha10, n.k, o.k is not null as has_old, {", ".join(f"round(o.{m}, 6) as old_{m}, round(n.{m}, 6) as new_{m}, round(n.{m} - o.{m}, 6) as delta_{m}" for m in METRICS)}
  from (select * from mt where seed = {NEW}) n left join (select * from mt where seed = {OLD} and layer < 3) o using (layer, alpha10, k))"""


@query("run_comparison", f"with {_RUNS} select cp.*, row_number() over (order by abs(coalesce(delta_rank_separation_gain, 0)) desc, layer, alpha10, k) as place from cp")
def run_comparison(spark, d):
    """Both runs, written as one wide CSV, an empty cell for null, and read back; the largest change of the rank separation first."""
    runs = scratch.cut(run_metrics(grid_records(spark, d, wanted=lambda seed, layer: seed in (OLD, NEW))), "runs")
    rows = rounded(compare(runs.where(F.col("seed") == NEW), runs.where((F.col("seed") == OLD) & (F.col("layer") < LAYERS - 1))), *WIDE)
    path = scratch.new_path(spark, "metrics")
    store.write_csv(rows, path)
    back = store.read_csv(spark, path, "layer int, alpha10 int, k int, has_old boolean, " + ", ".join(f"{c} double" for c in WIDE))
    order = Window.orderBy(F.desc(F.abs(F.coalesce("delta_rank_separation_gain", F.lit(0.0)))), *KEYS)  # the grid, of stated size
    return back.withColumn("place", F.row_number().over(order).cast("long"))


# ---- answers under prompt conditions ----------------------------------------------------------------------------

CONDITIONS = {"none": "array()", "factual": "array(fact)", "other": "array(other)", "factual_first": "array(fact, other)", "other_first": "array(other, fact)"}
HEAD = 12


def recite(prompts: list[str]) -> list[str]:
    """Stand-in for a generator: the first words of the first document; without one, what it remembers of the question."""
    return [a if p.startswith("Documents:\n[1]") else "the " + hashlib.sha256(p.encode()).hexdigest()[:4] for p, a in zip(prompts, first_words(prompts))]


@query(
    "condition_accuracy",
    """with h as (select doc_id, lang, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '') as w from documents),
s as (select a.doc_id, coalesce(a.lang, '') as lang, array_to_string(a.w[1:12], ' ') as fact, array_to_string(coalesce(b.w[1:12], []), ' ') as other, coalesce(a.w[3], '') as alias from h a left join h b on b.doc_id = a.doc_id + 1),
c as (select doc_id, alias, unnest(['none', 'factual', 'other', 'factual_first', 'other_first']) as condition, unnest([null, fact, other, fact, other]) as first, unnest([null, null, null, other, fact]) as second, lang from s),
p as (select doc_id, condition, alias, first, concat('Documents:', chr(10), case when first is not null then '[1] ' || first else '' end, case when second is not null then chr(10) || '[2] ' || second else '' end, chr(10), chr(10), 'Question: ', lang, ' ', doc_id % 50, '?', chr(10), 'Answer:') as prompt from c),
r as (select doc_id, condition, trim(alias) <> '' and contains(lower(case when first is null then 'the ' || substr(sha256(prompt), 1, 4) else array_to_string(string_split(first, ' ')[1:8], ' ') end), lower(trim(alias))) as ok from p),
kn as (select doc_id from r where condition = 'none' and ok),
ac as (select condition, avg(ok::int) as accuracy, avg(ok::int) filter (where doc_id in (select doc_id from kn)) as known_accuracy, count(*) as n from r group by condition)
select condition, round(accuracy, 6) as accuracy, round(known_accuracy, 6) as known_accuracy, n from ac
union all select 'positional_slope', round(f.accuracy - o.accuracy, 6), round(f.known_accuracy - o.known_accuracy, 6), f.n from ac f, ac o where f.condition = 'factual_first' and o.condition = 'other_first'""",
)
def condition_accuracy(spark, d):
    """Accuracy with no, the factual, another and both documents, for all and for those known without any; the slope is what the factual document gains by standing first.

    A document's first words are the factual text, those of the next id the other, its third word the accepted answer; each distinct prompt is answered once.
    """
    words = ft.words(F.coalesce("text", F.lit("")))
    heads = table(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.array_join(F.slice(words, 1, HEAD), " ").alias("fact"))
    other = heads.select((F.col("doc_id") - 1).alias("doc_id"), F.col("fact").alias("other"))
    rows = heads.join(other, "doc_id", "left").withColumns({"other": F.coalesce("other", F.lit("")), "golds": F.array(F.coalesce(F.get(F.split("fact", " "), F.lit(2)), F.lit("")))})
    each = rows.select("doc_id", "lang", "golds", F.explode(F.array(*[F.struct(F.lit(c).alias("condition"), F.expr(e).cast("array<string>").alias("docs")) for c, e in CONDITIONS.items()])).alias("c"))
    question = F.concat("lang", F.lit(" "), (F.col("doc_id") % 50).cast("string"), F.lit("?"))
    asked_ = each.select("doc_id", "golds", F.col("c.condition").alias("condition"), ft.prompt(F.col("c.docs"), question).alias("prompt"))
    r = scratch.cut(providers.generate(asked_, "prompt", recite).select("doc_id", "condition", ft.matches_first3(F.col("answer"), F.col("golds")).alias("ok")), "conditions")
    known = r.where("condition = 'none' and ok").select("doc_id", F.lit(True).alias("known")).distinct()
    acc = r.join(known, "doc_id", "left").groupBy("condition").agg(metrics.rate(F.col("ok")).alias("accuracy"), F.avg(F.when(F.col("known"), F.col("ok").cast("double"))).alias("known_accuracy"), F.count("*").alias("n"))
    acc = scratch.cut(acc, "accuracy")
    first, second = (acc.where(F.col("condition") == c).select(F.col("accuracy").alias(f"a{k}"), F.col("known_accuracy").alias(f"b{k}"), F.col("n").alias(f"n{k}")) for k, c in enumerate(("factual_first", "other_first")))
    slope = first.crossJoin(F.broadcast(second)).select(F.lit("positional_slope").alias("condition"), (F.col("a0") - F.col("a1")).alias("accuracy"), (F.col("b0") - F.col("b1")).alias("known_accuracy"), F.col("n0").alias("n"))  # one row each
    return rounded(acc.unionByName(slope), "accuracy", "known_accuracy")


# ---- re-ranking by a judge --------------------------------------------------------------------------------------

_PROMPTED = "concat('Rate from 0 to 1 how factual this is.', chr(10), coalesce(text, ''), chr(10), 'Score:')"


@query(
    "judge_rerank",
    f"""with {_simple_sql().replace("p as (select vec_id as id, list_dot_product(vec, dir) as p from v, dir)", f"h as (select doc_id, ('0x' || substr(md5({_PROMPTED}), 1, 2))::bigint as h from documents), p as (select vec_id as id, case when coalesce(h, 0) < 16 then 0.5 else round(h / 255.0::double, 2) end as p from v left join h on doc_id = vec_id)")}, {REC.format(by="q, alpha10")}, k(k) as (values (2), (5), (10))
select alpha10, k, round(avg((gold_rank <= k)::int), 6) as gold_rate, round(avg((nf_rank <= k)::int), 6) as nf_rate, count(*) as n from res, k group by alpha10, k""",
)
def judge_rerank(spark, d):
    """The re-ranking grid with a judge's score of the document in place of the projection; a score that can't be read, or of no document, is 0.5."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), ft.judge_prompt(F.coalesce("text", F.lit(""))).alias("prompt"))
    scored = providers.with_result(docs, "prompt", providers.per_text(docs, "prompt", providers.judge, "raw", "string")).select("vec_id", ft.judge_score(F.col("raw"))["score"].alias("score"))
    v = vectors(spark, d).join(scored, "vec_id", "left")
    v = scratch.cut(v.select("vec_id", F.concat("vec", F.array(F.coalesce("score", F.lit(0.5)))).alias("vec"), "fact"), "judged")
    own = [0.0] * len(v.first()["vec"][:-1]) + [1.0] if not v.isEmpty() else [1.0]
    records = rerank.target_ranks(v, asked(v), [own], ALPHAS, tail=1).drop("dir")
    return rounded(metrics.hit_rates(records, ["alpha10"], list(KS)), "gold_rate", "nf_rate")
