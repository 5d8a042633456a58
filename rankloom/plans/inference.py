"""Statistical queries: separation, bootstrap intervals, nulls and controls."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as fv
from ..operators import metrics, ordered, ranking, resample, sampling, stats
from ..sources.scratch import cut
from .base import DIR, WIDTH, E, V, query, r6, rounded, table, values, vectors
from .rerank import direction_row

B, UNITS = 200, 100
#: Bootstrap weights in SQL: how often each of the units is drawn in each resample.
DRAWS = f"""bi as (select range as b, unnest(range({UNITS})) as i from range({B})),
w as (select b, ('0x' || substr(md5(concat_ws(':', 11, b, i)), 1, 8))::bigint % {UNITS} as idx, count(*) as w from bi group by all)"""
#: Units: mean value of each user hash class and event type.
UNIT = f"u as (select event_type, user_id % {UNITS} as idx, avg(value) as x from events group by all)"


def units(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type", (F.col("user_id") % UNITS).alias("idx")).agg(F.avg("value").alias("x"))


def draws(df: DataFrame) -> DataFrame:
    return sampling.resample_counts(df, B, UNITS, 11)


P = f"{DIR}, p as (select vec_id, label, fact, list_dot_product(vec, dir) as s from v, dir)"
PROJ = f"{V}, {E}, {P}"


def projections(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return v.crossJoin(F.broadcast(direction_row(v))).select("vec_id", "label", "fact", fv.dot(F.col("vec"), F.col("dir")).alias("s"))  # one direction


RANKED = "r as (select *, rank() over (partition by {by} order by s) + (count(*) over (partition by {by}, s) - 1) / 2.0::double as r from {of})"


@query(
    "zscore_policies",
    f"""with {PROJ}, x as (select vec_id, label, case when label = 0 then 1.0 else s end as s from p)
select vec_id, label, round((s - avg(s) over ()) / stddev_pop(s) over (), 6) as z_global, round(case when stddev_pop(s) over w > 1e-12 then (s - avg(s) over w) / stddev_pop(s) over w end, 6) as z_null,
round((s - avg(s) over w) / (stddev_pop(s) over w + 1e-8), 6) as z_eps, round(case when stddev_pop(s) over w < 1e-12 then 0 else (s - avg(s) over w) / stddev_pop(s) over w end, 6) as z_zero from x window w as (partition by label)""",
)
def zscore_policies(spark, d):
    x = projections(spark, d).withColumn("s", F.when(F.col("label") == 0, 1.0).otherwise(F.col("s"))).drop("fact")
    for by, out, policy in (([], "z_global", "null"), (["label"], "z_null", "null"), (["label"], "z_eps", "eps"), (["label"], "z_zero", "zero")):
        x = ranking.zscore(x, "s", by, out, policy)
    return rounded(x.drop("s"), "z_global", "z_null", "z_eps", "z_zero")


@query(
    "rank_position_vs_competition",
    """select doc_id, lang, row_number() over (partition by lang order by n_chars desc, doc_id) as pos, rank() over (partition by lang order by n_chars desc) as rank,
rank() over (partition by lang order by n_chars) + (count(*) over (partition by lang, n_chars) - 1) / 2.0::double as average_rank, row_number() over (partition by lang order by n_chars desc, doc_id) = 1 as is_argmax from documents""",
)
def rank_position_vs_competition(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("s"))
    return ranking.ranks(docs, ["lang"], "s", "doc_id").select("doc_id", "lang", "pos", "rank", "average_rank", (F.col("pos") == 1).alias("is_argmax"))


@query("claim_auroc", f"with {PROJ}, f as (select vec_id % 5 as fold, fact, s from p), {RANKED.format(by='fold', of='f')} select fold, round((sum(r) filter (where fact) - count(*) filter (where fact) * (count(*) filter (where fact) + 1) / 2) / (count(*) filter (where fact) * count(*) filter (where not fact)), 6) as auroc from r group by fold")
def claim_auroc(spark, d):
    return rounded(stats.auroc(projections(spark, d).withColumn("fold", F.col("vec_id") % 5), ["fold"], "s", "fact"), "auroc")


@query(
    "quality_auroc",
    f"""with f as (select lang, quality = 1 as fact, n_chars::double as s from documents join labels using (doc_id)), {RANKED.format(by='lang', of='f')} select lang, round((sum(r) filter (where fact) - count(*) filter (where fact) * (count(*) filter (where fact) + 1) / 2)
/ nullif(count(*) filter (where fact) * count(*) filter (where not fact), 0), 6) as auroc from r group by lang""",
)
def quality_auroc(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("lang", (F.col("quality") == 1).alias("fact"), F.col("n_chars").cast("double").alias("s"))
    return rounded(stats.auroc(rows, ["lang"], "s", "fact"), "auroc")


@query(
    "balanced_accuracy",
    f"""with {PROJ}, f as (select vec_id % 5 as fold, vec_id, fact, s from p), c as (select fold, sum(fact::int) over w as tp, sum((not fact)::int) over w as fp from f window w as (partition by fold order by s desc, vec_id rows unbounded preceding)),
n as (select fold, sum(fact::int) as p, sum((not fact)::int) as n, (avg((s > 0)::int) filter (where fact) + avg((s <= 0)::int) filter (where not fact)) / 2 as zero from f group by fold),
a as (select fold, tp / p / 2 + (1 - fp / n) / 2 as a, zero from c join n using (fold)) select fold, round(greatest(max(a), 1 - min(a), 0.5), 6) as best, round(any_value(zero), 6) as at_zero from a group by fold""",
)
def balanced_accuracy(spark, d):
    rows = projections(spark, d).withColumn("fold", F.col("vec_id") % 5)
    best = stats.best_balanced(rows, ["fold"], "s", "fact", "vec_id")
    zero = rows.groupBy("fold").agg(stats.balanced_at_zero(F.col("s"), F.col("fact")).alias("at_zero"))
    return best.join(zero, "fold").select("fold", r6("balanced").alias("best"), r6("at_zero").alias("at_zero"))


@query(
    "spearman",
    """with r as (select event_type, rank() over (partition by event_type order by value) + (count(*) over (partition by event_type, value) - 1) / 2.0::double as x,
rank() over (partition by event_type order by user_id) + (count(*) over (partition by event_type, user_id) - 1) / 2.0::double as y from events) select event_type, round(corr(x, y), 6) as rho from r group by event_type""",
)
def spearman(spark, d):
    return rounded(stats.spearman(table(spark, d, "events").select("event_type", "value", "user_id"), ["event_type"], "value", "user_id"), "rho")


@query(
    "paired_auroc",
    f"""with {PROJ}, h as (select label % 5 as pair, fact, s, row_number() over (partition by label order by vec_id) as k from p), d2 as (select a.pair, a.s - b.s as delta from h a join h b on a.pair = b.pair and a.k = b.k and a.fact and not b.fact)
select pair::int as pair, round(avg(case when delta > 0 then 1.0 when delta < 0 then 0.0 else 0.5 end), 6) as auroc, count(*) as n from d2 group by pair""",
)
def paired_auroc(spark, d):
    rows = projections(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).withColumn("pair", (F.col("label") % 5).cast("int"))
    sides = rows.groupBy("pair", "k").agg(F.max(F.when(F.col("fact"), F.col("s"))).alias("a"), F.max(F.when(~F.col("fact"), F.col("s"))).alias("b")).where("a is not null and b is not null")
    return sides.groupBy("pair").agg(r6(F.avg(fv.sign_score(F.col("a") - F.col("b")))).alias("auroc"), F.count("*").alias("n"))


NORMAL = "sqrt(-2 * ln((('0x' || substr(md5(concat_ws(':', seed, i)), 1, 8))::bigint::double + 1) / 4294967296.0)) * cos(2 * 3.141592653589793::double * ('0x' || substr(md5(concat_ws(':', seed, i)), 9, 8))::bigint::double / 4294967296.0)"


def null_directions(seeds: DataFrame) -> DataFrame:
    """(seed, i, x): a unit vector of hashed normal numbers for each (seed, width)."""
    rows = seeds.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("width") - 1))).drop("width").withColumn("x", fv.hashed_normal(F.col("seed"), F.col("i")))
    return rows.withColumn("x", F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("seed"))))  # a vector's components


@query("null_unit_vectors", f"with r as (select seed, unnest(range(width)) as i from (select label as seed, max(len(embedding)) as width from embeddings group by label)), n as (select seed, i, {NORMAL} as x from r) select seed, i::int as i, round(x / sqrt(sum(x * x) over (partition by seed)), 6) as x from n")
def null_unit_vectors(spark, d):
    """A random direction for each label, as wide as its vectors."""
    return rounded(null_directions(vectors(spark, d).groupBy(F.col("label").alias("seed")).agg(F.max(F.size("vec")).alias("width"))), "x")


def _projected(directions):
    def run(batches):
        w = np.array(directions)
        for b in batches:
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            p = np.round(x @ w.T, 12)
            seeds = np.tile(np.arange(len(w)), b.num_rows)
            row = np.repeat(np.arange(b.num_rows), len(w))
            yield pa.RecordBatch.from_arrays([pa.array(seeds), b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(p.ravel())], ["seed", "vec_id", "fact", "s"])

    return run


def null_aurocs(spark: SparkSession, d: str, n: int) -> DataFrame:
    """(seed, auroc) of projections on null directions; a batch of vectors meets all of them in one product."""
    rows = fv.collect(null_directions(spark.range(n).select(F.col("id").alias("seed"), F.lit(WIDTH).alias("width"))), ["seed"], "x", "w").orderBy("seed").collect()  # n directions
    proj = vectors(spark, d).where("vec is not null").select("vec_id", "fact", "vec").mapInArrow(_projected([r["w"] for r in rows]), "seed long, vec_id long, fact boolean, s double")
    return stats.auroc(proj, ["seed"], "s", "fact")


NULLS = f"""{V}, {E}, rr as (select range as seed, unnest(range(64)) as i from range(30)), nn as (select seed, i, {NORMAL} as x from rr), nu as (select seed, i, x / sqrt(sum(x * x) over (partition by seed)) as w from nn),
np as (select seed, vec_id, fact, round(sum(x * w), 12) as s from e join nu using (i) group by all), {RANKED.format(by='seed', of='np')},
au as (select seed, (sum(r) filter (where fact) - count(*) filter (where fact) * (count(*) filter (where fact) + 1) / 2) / (count(*) filter (where fact) * count(*) filter (where not fact)) as auroc from r group by seed)"""


@query("null_band", f"with {NULLS} select round(quantile_cont(auroc, 0.025), 6) as lo, round(quantile_cont(auroc, 0.5), 6) as mid, round(quantile_cont(auroc, 0.975), 6) as hi, round(quantile_cont(greatest(auroc, 1 - auroc), 0.975), 6) as folded_hi, count(*) as n from au")
def null_band(spark, d):
    a = F.col("auroc")
    pct = lambda c, q: r6(F.percentile(c, F.lit(q)))
    return null_aurocs(spark, d, 30).agg(pct(a, 0.025).alias("lo"), pct(a, 0.5).alias("mid"), pct(a, 0.975).alias("hi"), pct(F.greatest(a, 1 - a), 0.975).alias("folded_hi"), F.count("*").alias("n"))


@query("null_gate", f"with {NULLS} select round(quantile_cont(auroc, 0.025), 6) as lo, round(quantile_cont(auroc, 0.975), 6) as hi, quantile_cont(auroc, 0.025) <= 0.5 and 0.5 <= quantile_cont(auroc, 0.975) as passed from au")
def null_gate(spark, d):
    lo, hi = (F.percentile("auroc", F.lit(q)) for q in (0.025, 0.975))
    return null_aurocs(spark, d, 30).agg(r6(lo).alias("lo"), r6(hi).alias("hi"), ((lo <= 0.5) & (hi >= 0.5)).alias("passed"))


@query("bootstrap_ci", f"with {UNIT}, {DRAWS}, m as (select event_type, b, sum(w * x) / {UNITS} as mean from u join w using (idx) group by all) select event_type, round(quantile_cont(mean, 0.025), 6) as lo, round(quantile_cont(mean, 0.975), 6) as hi from m group by event_type")
def bootstrap_ci(spark, d):
    u = units(spark, d)
    return rounded(stats.interval(stats.bootstrap_means(u, draws(u), ["event_type"], "x", UNITS), ["event_type"]), "lo", "hi")


@query(
    "paired_delta_ci",
    f"""with {UNIT}, {DRAWS}, m as (select event_type, b, sum(w * x) / {UNITS} as mean from u join w using (idx) group by all), t as (select min(event_type) as first from u),
dl as (select m.event_type, m.b, m.mean - o.mean as delta from m join m o using (b), t where o.event_type = t.first and m.event_type <> t.first)
select event_type, round(quantile_cont(delta, 0.025), 6) as lo, round(quantile_cont(delta, 0.975), 6) as hi, quantile_cont(delta, 0.025) > 0 or quantile_cont(delta, 0.975) < 0 as excludes_zero, round(least(1, 2 * least(avg((delta <= 0)::int), avg((delta >= 0)::int))), 6) as p from dl group by event_type""",
)
def paired_delta_ci(spark, d):
    u = units(spark, d)
    means = stats.bootstrap_means(u, draws(u), ["event_type"], "x", UNITS)
    base = means.withColumns({"first": F.min("event_type").over(Window.partitionBy("b"))}).withColumn("base", F.max(F.when(F.col("event_type") == F.col("first"), F.col("mean"))).over(Window.partitionBy("b")))
    delta = base.where("event_type <> first").withColumn("delta", F.col("mean") - F.col("base"))
    out = delta.groupBy("event_type").agg(F.percentile("delta", F.lit(0.025)).alias("lo"), F.percentile("delta", F.lit(0.975)).alias("hi"), stats.two_sided(F.col("delta")).alias("p"))
    return rounded(out.withColumn("excludes_zero", (F.col("lo") > 0) | (F.col("hi") < 0)), "lo", "hi", "p")


@query(
    "design_effect",
    f"""with {UNIT}, {DRAWS}, cl as (select event_type, b, sum(w * x) / {UNITS} as mean from u join w using (idx) group by all), ev as (select event_type, event_id % {UNITS} as idx, avg(value) as x from events group by all),
nv as (select event_type, b, sum(w * x) / {UNITS} as mean from ev join w using (idx) group by all), a as (select event_type, var_samp(mean) as c from cl group by event_type), b as (select event_type, var_samp(mean) as n from nv group by event_type)
select event_type, round(c / nullif(n, 0), 4) as deff from a join b using (event_type)""",
)
def design_effect(spark, d):
    u = units(spark, d)
    naive = table(spark, d, "events").groupBy("event_type", (F.col("event_id") % UNITS).alias("idx")).agg(F.avg("value").alias("x"))
    w = draws(u)
    var = lambda rows, name: stats.bootstrap_means(rows, w, ["event_type"], "x", UNITS).groupBy("event_type").agg(F.var_samp("mean").alias(name))
    return var(u, "c").join(var(naive, "n"), "event_type").select("event_type", F.round(F.try_divide("c", "n"), 4).alias("deff"))


@query(
    "variance_decomposition",
    f"""with {DRAWS}, u as (select event_id % 8 as draw, user_id % {UNITS} as idx, avg(value) as x from events group by all), q as (select idx, avg(x) as x from u group by idx), qb as (select b, sum(w * x) / {UNITS} as mean from q join w using (idx) group by b),
dr as (select draw, avg(x) as x from u group by draw), db as (select range as b, unnest(range(8)) as i from range({B})), dw as (select b, ('0x' || substr(md5(concat_ws(':', 12, b, i)), 1, 8))::bigint % 8 as draw, count(*) as w from db group by all),
dm as (select b, sum(w * x) / 8 as mean from dr join dw using (draw) group by b), r as (select (select var_samp(mean) from qb) as question_var, (select var_samp(mean) from dm) as draw_var)
select round(question_var, 4) as question_var, round(draw_var, 4) as draw_var, round(draw_var / nullif(question_var, 0), 4) as share, case when draw_var / nullif(question_var, 0) < 0.1 then 'negligible' when draw_var / nullif(question_var, 0) < 0.3 then 'moderate' else 'large' end as verdict from r""",
)
def variance_decomposition(spark, d):
    u = table(spark, d, "events").groupBy((F.col("event_id") % 8).alias("draw"), (F.col("user_id") % UNITS).alias("idx")).agg(F.avg("value").alias("x"))
    q = u.groupBy("idx").agg(F.avg("x").alias("x"))
    by_q = stats.bootstrap_means(q, draws(u), [], "x", UNITS).agg(F.var_samp("mean").alias("question_var"))
    by_draw = u.groupBy(F.col("draw").alias("idx")).agg(F.avg("x").alias("x"))
    by_d = stats.bootstrap_means(by_draw, sampling.resample_counts(u, B, 8, 12), [], "x", 8).agg(F.var_samp("mean").alias("draw_var"))
    share = F.try_divide("draw_var", "question_var")
    verdict = F.when(share < 0.1, "negligible").when(share < 0.3, "moderate").otherwise("large")
    return by_q.crossJoin(by_d).select(F.round("question_var", 4).alias("question_var"), F.round("draw_var", 4).alias("draw_var"), F.round(share, 4).alias("share"), verdict.alias("verdict"))  # one row each


@query("layer_band", "with c as (select event_type, user_id % 5 as seed, event_id % 4 as layer, avg(value) as x from events group by all) select event_type, round(quantile_cont(x, 0.1), 6) as p10, round(quantile_cont(x, 0.9), 6) as p90, count(*) as cells from c group by event_type")
def layer_band(spark, d):
    cells = table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 5).alias("seed"), (F.col("event_id") % 4).alias("layer")).agg(F.avg("value").alias("x"))
    return cells.groupBy("event_type").agg(r6(F.percentile("x", F.lit(0.1))).alias("p10"), r6(F.percentile("x", F.lit(0.9))).alias("p90"), F.count("*").alias("cells"))


def deltas(spark: SparkSession, d: str) -> DataFrame:
    """(event_type, user, delta): each user class's mean in even events minus that in odd ones, in tenths so that ties occur."""
    e = table(spark, d, "events").groupBy("event_type", (F.col("user_id") % UNITS).alias("user")).agg(F.avg(F.when(F.col("event_id") % 2 == 0, F.col("value"))).alias("a"), F.avg(F.when(F.col("event_id") % 2 == 1, F.col("value"))).alias("b"))
    return e.where("a is not null and b is not null").select("event_type", "user", F.round((F.col("a") - F.col("b")) / 10).alias("delta"))


@query(
    "wilcoxon_stat",
    f"""with e as (select event_type, user_id % {UNITS} as user, avg(value) filter (where event_id % 2 = 0) as a, avg(value) filter (where event_id % 2 = 1) as b from events group by all),
x as (select event_type, round((a - b) / 10) as delta from e where a is not null and b is not null), r as (select event_type, delta, rank() over (partition by event_type order by abs(delta)) + (count(*) over (partition by event_type, abs(delta)) - 1) / 2.0::double as r from x)
select event_type, count(*) as n, sum(case when delta = 0 then r / 2 when delta > 0 then r else 0 end) as w_plus, sum(case when delta = 0 then r / 2 when delta < 0 then r else 0 end) as w_minus from r group by event_type""",
)
def wilcoxon_stat(spark, d):
    return stats.signed_ranks(deltas(spark, d), ["event_type"], "delta").drop("variance")


@query("wilcoxon_p")
def wilcoxon_p(spark, d):
    return rounded(stats.wilcoxon(deltas(spark, d), ["event_type"], "delta").drop("variance"), "z", "p")


@query("question_band", f"with u as (select event_type, user_id % {UNITS} as idx, avg((value > 50)::int)::double as x from events group by all), {DRAWS}, m as (select event_type, b, sum(w * x) / {UNITS} as mean from u join w using (idx) group by all), o as (select event_type, avg(x) as mean from u group by all) select event_type, round(any_value(o.mean), 6) as mean, round(quantile_cont(m.mean, 0.025), 6) as lo, round(quantile_cont(m.mean, 0.975), 6) as hi from m join o using (event_type) group by event_type")
def question_band(spark, d):
    u = table(spark, d, "events").groupBy("event_type", (F.col("user_id") % UNITS).alias("idx")).agg(metrics.rate(F.col("value") > 50).alias("x"))
    ci = stats.interval(stats.bootstrap_means(u, draws(u), ["event_type"], "x", UNITS), ["event_type"])
    return rounded(u.groupBy("event_type").agg(F.avg("x").alias("mean")).join(ci, "event_type"), "mean", "lo", "hi")


@query("reference_lines", f"with {V}, m as (select label, count(*) as n, count(*) filter (where fact) as f from v group by label) select label, round(1.0::double / n, 6) as random, round(1.0::double / nullif(f, 0), 6) as factual from m")
def reference_lines(spark, d):
    pools = vectors(spark, d).groupBy("label").agg(F.count("*").alias("n"), F.count_if("fact").alias("f"))
    return pools.select("label", r6(1.0 / F.col("n")).alias("random"), r6(F.try_divide(F.lit(1.0), F.nullif("f", F.lit(0)))).alias("factual"))


@query("std_ddof_family", "with c as (select event_type, user_id % 50 as u, avg(value) as x from events where user_id % 50 < 49 or event_type = 'click' group by all) select event_type, round(avg(x), 6) as mean, round(coalesce(stddev_samp(x), 0), 6) as std_sample, round(stddev_pop(x), 6) as std_population, count(*) as n from c group by event_type")
def std_ddof_family(spark, d):
    c = table(spark, d, "events").where("user_id % 50 < 49 or event_type = 'click'").groupBy("event_type", (F.col("user_id") % 50).alias("u")).agg(F.avg("value").alias("x"))
    return c.groupBy("event_type").agg(r6(F.avg("x")).alias("mean"), r6(stats.std_or_zero("x")).alias("std_sample"), r6(F.stddev_pop("x")).alias("std_population"), F.count("*").alias("n"))


@query("degenerate_groups", "with g as (select lang, source, stddev_pop(n_chars) as s, count(*) as n from documents group by all) select lang, count(*) filter (where s < 1e-12) as flat, count(*) filter (where n < 3) as small, count(*) as groups from g group by lang")
def degenerate_groups(spark, d):
    g = table(spark, d, "documents").groupBy("lang", "source").agg(F.stddev_pop("n_chars").alias("s"), F.count("*").alias("n"))
    return g.groupBy("lang").agg(F.count_if(F.col("s") < 1e-12).alias("flat"), F.count_if(F.col("n") < 3).alias("small"), F.count("*").alias("groups"))


@query("distribution_summary", "select lang, round(avg(n_chars), 6) as mean, round(quantile_cont(n_chars, 0.5), 6) as median, round(quantile_cont(n_chars, 0.1), 6) as p10, round(quantile_cont(n_chars, 0.25), 6) as p25, round(avg((n_chars > 500)::int), 6) as share_long from documents group by lang")
def distribution_summary(spark, d):
    docs = table(spark, d, "documents").select("lang", "n_chars")
    means = docs.groupBy("lang").agg(r6(F.avg("n_chars")).alias("mean"), r6(metrics.rate(F.col("n_chars") > 500)).alias("share_long"))
    return ordered.matched(means, rounded(ordered.quantiles(docs, ["lang"], "n_chars", {"median": 0.5, "p10": 0.1, "p25": 0.25}), "median", "p10", "p25"), ["lang"], "left")


@query("centred_cosine_membership", f"""with {V}, {E}, {DIR}, mu as (select i, avg(x) as m from e group by i), mv as (select list(m order by i) as mu from mu), s as (select label, (case when label < 5 then 1 when label < 8 then -1 else 0 end)::int as member, list_transform(list_zip(vec, mu), lambda z: z[1] - z[2]) as c from v, mv),
x as (select label, member, list_dot_product(c, dir) / sqrt(list_dot_product(dir, dir)) / (sqrt(list_dot_product(c, c)) + 1e-8) as cs from s, dir) select label, member, round(avg(cs), 6) as mean, round(coalesce(stddev_samp(cs), 0), 6) as std from x group by all""")
def centred_cosine_membership(spark, d):
    v = vectors(spark, d)
    mean = fv.collect(fv.explode(v, "vec").groupBy("i").agg(F.avg("x").alias("m")).withColumn("one", F.lit(1)), ["one"], "m", "mu").select("mu")
    rows = v.crossJoin(F.broadcast(mean)).crossJoin(F.broadcast(direction_row(v)))  # one row each
    member = F.when(F.col("label") < 5, 1).when(F.col("label") < 8, -1).otherwise(0)
    scored = rows.select("label", member.alias("member"), fv.centred_cosine(F.col("vec"), F.col("mu"), F.col("dir")).alias("cs"))
    return scored.groupBy("label", "member").agg(r6(F.avg("cs")).alias("mean"), r6(stats.std_or_zero("cs")).alias("std"))


@query("feature_separation_topk", f"with {V}, {E}, f as (select i, avg((x > 0)::int) filter (where fact) as fp, avg((x > 0)::int) filter (where not fact) as fn, avg(x) as w from e group by i) select i::int as i, round(fp - fn, 6) as separation, round(w, 6) as weight, row_number() over (order by round(fp - fn, 9) desc, i) as place from f qualify place <= 8")
def feature_separation_topk(spark, d):
    fires = lambda c: F.avg(F.when(c, (F.col("x") > 0).cast("double")))
    f = fv.explode(vectors(spark, d), "vec", "fact").groupBy("i").agg((fires(F.col("fact")) - fires(~F.col("fact"))).alias("separation"), F.avg("x").alias("weight"))
    place = F.row_number().over(Window.orderBy(F.desc(F.round("separation", 9)), "i")).cast("long")  # one row a component
    return rounded(f.withColumn("place", place).where("place <= 8"), "separation", "weight")


@query("weighted_feature_sum", f"with {V}, {E}, w as (select vec_id, row_number() over (order by md5(concat_ws(':', 3, vec_id)), vec_id) as k from v qualify k <= 5) select i::int as i, round(sum(x * k), 6) as v from e join w using (vec_id) group by i")
def weighted_feature_sum(spark, d):
    v = vectors(spark, d)
    few = sampling.capped(v, 5, 3, "vec_id").select("vec_id").withColumn("k", F.row_number().over(Window.orderBy(sampling.order_key(3, F.col("vec_id")), "vec_id")))
    return fv.explode(v.join(F.broadcast(few), "vec_id"), "vec", "k").groupBy("i").agg(r6(F.sum(F.col("x") * F.col("k"))).alias("v"))  # five rows


@query("span_decode", f"with {V}, s as (select vec_id, list_position(vec, list_max(vec)) - 1 as start, vec from v), n as (select vec_id, start, vec[start + 1 : start + 30] as win from s) select vec_id, start::int as start, (start + list_position(win, list_max(win)))::int as \"end\", round(win[1], 6) as logit from n")
def span_decode(spark, d):
    start = fv.argmax(F.col("vec"))
    rows = vectors(spark, d).select("vec_id", start.alias("start"), "vec").withColumn("win", F.slice("vec", F.col("start") + 1, F.lit(30)))
    return rows.select("vec_id", "start", (F.col("start") + fv.argmax(F.col("win")) + 1).alias("end"), r6(F.element_at("win", 1)).alias("logit"))


@query("unit_normalise", f"with {V}, u as (select vec_id, sqrt(list_dot_product(vec, vec)) as n, vec from v) select vec_id, round(n, 6) as norm, round(vec[1] / n, 6) as first, round(vec[1] / (n + 1e-8), 6) as first_eps, round(list_sum(list_transform(vec, lambda x: x * x)) / (n * n), 6) as unit_norm from u")
def unit_normalise(spark, d):
    c = F.col("vec")
    return vectors(spark, d).select("vec_id", r6(fv.norm(c)).alias("norm"), r6(F.element_at(fv.unit(c), 1)).alias("first"), r6(F.element_at(fv.unit(c, 1e-8), 1)).alias("first_eps"), r6(F.pow(fv.norm(fv.unit(c)), 2)).alias("unit_norm"))


@query("finite_guard", f"with {V} select label, count(*) filter (where len(list_filter(vec, lambda x: x is null or isnan(x) or isinf(x))) = 0) as finite, count(*) as n, min(len(vec))::int as width from v group by label")
def finite_guard(spark, d):
    return vectors(spark, d).groupBy("label").agg(F.count_if(fv.finite(F.col("vec"))).alias("finite"), F.count("*").alias("n"), F.min(F.size("vec")).alias("width"))


@query("vector_gather", f"with {V} select vec_id, round(vec[6], 6) as a, round(vec[1], 6) as b, round(vec[64], 6) as c, len(vec)::int as filled from v")
def vector_gather(spark, d):
    picked = fv.gather(F.col("vec"), F.array(F.lit(5), F.lit(0), F.lit(63)))
    rows = vectors(spark, d).select("vec_id", picked.alias("g"), F.array_repeat(F.lit(0.0), F.size("vec")).alias("zeros"))
    return rows.select("vec_id", *[r6(F.col("g")[k]).alias(n) for k, n in enumerate("abc")], F.size("zeros").alias("filled"))


@query("kde_grid", f"with {PROJ}, g as (select (range - 20) / 10.0::double as x from range(41)) select round(x, 6) as x, round(avg(exp(-0.5 * pow((x - s) / 0.25, 2)) / (0.25 * 2.5066282746310002)), 6) as density from p, g group by x")
def kde_grid(spark, d):
    grid = spark.range(41).select(((F.col("id") - 20) / F.lit(10.0)).alias("x"))
    return rounded(stats.density(projections(spark, d), grid, "s", 0.25), "x", "density")


@query("claim_separation", f"""with {NULLS.replace('), r as (', '), nr as (').replace('from r group by seed)', 'from nr group by seed)')}, {P}, f as (select label % 2 as model, vec_id, fact, s from p), {RANKED.format(by='model', of='f')},
a as (select model, (sum(r) filter (where fact) - count(*) filter (where fact) * (count(*) filter (where fact) + 1) / 2) / (count(*) filter (where fact) * count(*) filter (where not fact)) as auroc,
(avg((s > 0)::int) filter (where fact) + avg((s <= 0)::int) filter (where not fact)) / 2 as zero from r group by model),
c as (select model, sum(fact::int) over w as tp, sum((not fact)::int) over w as fp from f window w as (partition by model order by s desc, vec_id rows unbounded preceding)),
n as (select model, sum(fact::int) as p, sum((not fact)::int) as n from f group by model), b as (select model, greatest(max(tp / p / 2 + (1 - fp / n) / 2), 1 - min(tp / p / 2 + (1 - fp / n) / 2), 0.5) as best from c join n using (model) group by model),
nb as (select quantile_cont(auroc, 0.025) as lo, quantile_cont(auroc, 0.975) as hi, quantile_cont(greatest(auroc, 1 - auroc), 0.975) as folded from au)
select model, round(auroc, 6) as auroc, round(greatest(auroc, 1 - auroc), 6) as auroc_abs, round(zero, 6) as balanced_zero, round(best, 6) as balanced_best, round(lo, 6) as null_lo, round(hi, 6) as null_hi, greatest(auroc, 1 - auroc) > folded as above_null from a join b using (model), nb""")
def claim_separation(spark, d):
    """How well the projections tell the sides of each part, with the band of random directions that a separation must leave."""
    rows = cut(projections(spark, d).withColumn("model", F.col("label") % 2), "claims")
    both = stats.auroc(rows, ["model"], "s", "fact").join(rows.groupBy("model").agg(stats.balanced_at_zero(F.col("s"), F.col("fact")).alias("balanced_zero")), "model")
    both = both.join(stats.best_balanced(rows, ["model"], "s", "fact", "vec_id").withColumnRenamed("balanced", "balanced_best"), "model")
    a, pct = F.col("auroc"), lambda c, q: F.percentile(c, F.lit(q))  # noqa: E731  a row a direction
    band = null_aurocs(spark, d, 30).agg(pct(a, 0.025).alias("null_lo"), pct(a, 0.975).alias("null_hi"), pct(F.greatest(a, 1 - a), 0.975).alias("__folded"))
    found = both.withColumn("auroc_abs", F.greatest("auroc", 1 - F.col("auroc"))).crossJoin(F.broadcast(band)).withColumn("above_null", F.col("auroc_abs") > F.col("__folded")).drop("__folded")  # one row
    return rounded(found, "auroc", "auroc_abs", "balanced_zero", "balanced_best", "null_lo", "null_hi")


@query("nested_group_curve", "with c as (select event_type, user_id % 3 as layer, event_id % 2 as seed, avg(value) as x from events group by all) select event_type, layer, round(avg(x), 6) as mean, round(coalesce(stddev_samp(x), 0), 6) as std, count(*) as seeds from c group by event_type, layer")
def nested_group_curve(spark, d):
    c = table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 3).alias("layer"), (F.col("event_id") % 2).alias("seed")).agg(F.avg("value").alias("x"))
    return c.groupBy("event_type", "layer").agg(r6(F.avg("x")).alias("mean"), r6(stats.std_or_zero("x")).alias("std"), F.count("*").alias("seeds"))


@query("cell_accuracy_map", "select concat_ws(';', user_id % 2, event_type) as cell, round(avg((value > 50)::int), 6) as acc from events group by all")
def cell_accuracy_map(spark, d):
    cells = table(spark, d, "events").groupBy((F.col("user_id") % 2).alias("m"), "event_type").agg(r6(metrics.rate(F.col("value") > 50)).alias("acc"))
    mapped = cells.groupBy("m").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "acc"))).alias("cells"))
    return mapped.select("m", F.explode("cells").alias("k", "acc")).select(F.concat_ws(";", F.col("m").cast("string"), "k").alias("cell"), "acc")


@query("dense_cells", "with m(e, l) as (select distinct event_type, k from events, (values (0), (1), (2)) k(k)), c as (select event_type as e, user_id % 3 as l, count(*) as n from events where not (event_type = 'click' and user_id % 3 = 1) group by all) select m.e as event_type, m.l as layer, coalesce(n, 0) as n, n is null as missing from m left join c using (e, l)")
def dense_cells(spark, d):
    events = table(spark, d, "events")
    grid = events.select("event_type").distinct().withColumn("layer", F.explode(F.array(*map(F.lit, range(3)))))
    have = events.where("not (event_type = 'click' and user_id % 3 = 1)").groupBy("event_type", (F.col("user_id") % 3).alias("layer")).agg(F.count("*").alias("n"))
    return grid.join(have, ["event_type", "layer"], "left").select("event_type", "layer", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("missing"))


@query("rounding_family", "select event_id, round(value, 2) as two, round(least(1, greatest(0, value / 100)), 4) as clipped, printf('%.3f', round(value, 3)) as shown from events")
def rounding_family(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.round("value", 2).alias("two"), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 100)), 4).alias("clipped"), F.format_string("%.3f", F.round("value", 3)).alias("shown"))


@query("judge_vs_direction", f"""with {PROJ}, j as (select vec_id, fact, s, ('0x' || substr(md5(concat_ws(':', 'judge', vec_id)), 1, 4))::bigint / 65535.0::double + case when fact then 0.2 else 0 end as judge from p),
t as (select * from (select 'direction' as method, vec_id, fact, s from j) union all (select 'judge', vec_id, fact, judge from j)), {RANKED.format(by='method', of='t')}
select method, round((sum(r) filter (where fact) - count(*) filter (where fact) * (count(*) filter (where fact) + 1) / 2) / (count(*) filter (where fact) * count(*) filter (where not fact)), 6) as auroc from r group by method""")
def judge_vs_direction(spark, d):
    p = projections(spark, d)
    judge = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("judge"), F.col("vec_id").cast("string"))), 1, 4), 16, 10).cast("long") / F.lit(65535.0) + F.when(F.col("fact"), 0.2).otherwise(0.0)
    both = p.select(F.lit("direction").alias("method"), "fact", "s").union(p.select(F.lit("judge"), "fact", judge))
    return rounded(stats.auroc(both, ["method"], "s", "fact"), "auroc")


@query("pair_separation", f"""with {PROJ}, k as (select label % 5 as pair, fact, s, row_number() over (partition by label order by vec_id) as k from p), x as (select a.k % {UNITS} as idx, avg(case when a.s > b.s then 1.0 when a.s < b.s then 0.0 else 0.5 end) as x from k a join k b on a.pair = b.pair and a.k = b.k and a.fact and not b.fact group by 1), {DRAWS},
n as (select count(*) as n from x), m as (select b, sum(w * x) / sum(w) as mean from x join w using (idx) group by b) select (select round(avg(x), 6) from x) as auroc, round(quantile_cont(mean, 0.025), 6) as lo, round(quantile_cont(mean, 0.975), 6) as hi, (select n from n) as units from m""")
def pair_separation(spark, d):
    rows = projections(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).withColumn("pair", F.col("label") % 5)
    sides = rows.groupBy("pair", "k").agg(F.max(F.when(F.col("fact"), F.col("s"))).alias("a"), F.max(F.when(~F.col("fact"), F.col("s"))).alias("b")).where("a is not null and b is not null")
    x = sides.groupBy((F.col("k") % UNITS).alias("idx")).agg(F.avg(fv.sign_score(F.col("a") - F.col("b"))).alias("x"))
    means = x.join(draws(x), "idx").groupBy("b").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("mean"))
    ci = means.agg(F.percentile("mean", F.lit(0.025)).alias("lo"), F.percentile("mean", F.lit(0.975)).alias("hi"))
    return rounded(x.agg(F.avg("x").alias("auroc"), F.count("*").alias("units")).crossJoin(ci), "auroc", "lo", "hi")  # one row each


@query("constant_values", f"with {V}, c as (select count(distinct label) as pools, count(distinct label) filter (where fact) as facts, count(*) as n from v) select 'random' as k, round(1.0::double / n, 6) as v from c union all select 'factual', round(1.0::double / nullif(facts, 0), 6) from c union all select 'relevant', round(1.0::double / pools, 6) from c")
def constant_values(spark, d):
    """The chances of a blind pick: of one vector, of one factual label, of one label."""
    n = vectors(spark, d).agg(F.count("*").alias("random"), F.count_distinct(F.when(F.col("fact"), F.col("label"))).alias("factual"), F.count_distinct("label").alias("relevant"))
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.try_divide(F.lit(1.0), F.col(k)).alias("v")) for k in ("random", "factual", "relevant")])
    return rounded(n.select(F.explode(pairs).alias("e")).select("e.k", "e.v"), "v")


@query("lineitem_bootstrap")
def lineitem_bootstrap(spark, d):
    """Mean price by return flag with an interval over resamples of all line items; every task derives the weights of its own."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_extendedprice").cast("double").alias("price"))
    units = cut(resample.numbered_units(lines, ["l_orderkey", "l_linenumber"]), "units")
    n = units.count()
    return rounded(resample.mean_interval(units, n, B, 17, ["l_returnflag"], "price"), "mean", "lo", "hi")
