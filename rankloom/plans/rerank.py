"""Re-ranking queries over the embeddings: similarity to a query fused with a projection on a direction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as fv
from ..operators import metrics, ordered, ranking, rerank, sampling, stats
from ..sources import scratch
from .base import ALPHAS, DIR, KS, LAYER_WIDTH, LAYERS, SEEDS, WIDTH, E, V, query, r6, rounded, table, values, vectors


def direction_row(v: DataFrame) -> DataFrame:
    """One row: dir, the difference of the sides' means."""
    return fv.collect(fv.mean_difference(v, "vec", F.col("fact")).withColumn("one", F.lit(1)), ["one"], "v", "dir").select("dir")


def asked(v: DataFrame) -> DataFrame:
    """The stated queries: every vector whose id is divisible by 20."""
    return v.where("vec_id % 20 = 0")


def simple_direction(v: DataFrame) -> list[list[float]]:
    """The one direction over the whole vectors, on the driver."""
    return [r["dir"] for r in direction_row(v).collect() if r["dir"]]


def simple_records(spark: SparkSession, d: str) -> DataFrame:
    """(q, alpha10, gold_rank, nf_rank) with one direction."""
    v = vectors(spark, d)
    return rerank.target_ranks(v, asked(v), simple_direction(v), ALPHAS).drop("dir")


def simple_top(spark: SparkSession, d: str, k: int, alphas=ALPHAS) -> DataFrame:
    """(q, alpha10, pos, id, s, side of id): the first k with one direction."""
    v = vectors(spark, d)
    return rerank.fused_top(v, asked(v), simple_direction(v), alphas, k).drop("dir")


def _simple_sql(alphas=ALPHAS) -> str:
    return f"""{V}, {E}, {DIR},
q as (select vec_id as q, vec as qv, fact as qf from v where vec_id % 20 = 0),
c as (select q, vec_id as id, fact = qf as same, fact, list_cosine_similarity(qv, vec) as cos from q, v where vec_id <> q),
tg as (select g.q, g.gold, n.nf from (select q, id as gold from c where same qualify row_number() over (partition by q order by round(cos, 9) desc, id) = 1) g
  join (select q, id as nf from c where not same qualify row_number() over (partition by q order by round(cos, 9) desc, id) = 1) n using (q)),
p as (select vec_id as id, list_dot_product(vec, dir) as p from v, dir),
zp as (select id, (p - avg(p) over ()) / stddev_pop(p) over () as zp from p),
zc as (select q, id, fact, (cos - avg(cos) over (partition by q)) / stddev_pop(cos) over (partition by q) as zc from c),
a(alpha10) as (values {", ".join(f"({a})" for a in alphas)}),
sc as (select q, alpha10, id, fact, round((1 - alpha10::double / 10) * zc + alpha10::double / 10 * zp, 9) as s from zc join zp using (id), a)"""


REC = """t as (select {by}, max(s) filter (where id = gold) as gs, max(s) filter (where id = nf) as ns from sc join tg using (q) group by {by}),
res as (select {by}, 1 + count(*) filter (where s > gs or (s = gs and id < gold)) as gold_rank, 1 + count(*) filter (where s > ns or (s = ns and id < nf)) as nf_rank
  from sc join tg using (q) join t using ({by}) group by {by})"""


@query(
    "rerank_rate_at_k",
    f"""with {_simple_sql()}, {REC.format(by="q, alpha10")}, k(k) as (values (2), (5), (10))
select alpha10, k, round(avg((gold_rank <= k)::int), 6) as gold_rate, round(avg((nf_rank <= k)::int), 6) as nf_rate, count(*) as n from res, k group by alpha10, k""",
)
def rerank_rate_at_k(spark, d):
    return rounded(metrics.hit_rates(simple_records(spark, d), ["alpha10"], list(KS)), "gold_rate", "nf_rate")


@query(
    "rerank_share_in_topk",
    f"""with {_simple_sql()}, r as (select *, row_number() over (partition by q, alpha10 order by s desc, id) as pos from sc), k(k) as (values (2), (5), (10))
select alpha10, k, round(avg(fact::int), 6) as fact_share, count(*) as n from r, k where pos <= k group by alpha10, k""",
)
def rerank_share_in_topk(spark, d):
    return simple_top(spark, d, max(KS)).withColumn("k", F.explode(F.array(*map(F.lit, KS)))).where("pos <= k").groupBy("alpha10", "k").agg(r6(metrics.rate(F.col("fact"))).alias("fact_share"), F.count("*").alias("n"))


@query(
    "topk_nested_array",
    f"""with {_simple_sql((5,))}
select q, row_number() over (partition by q order by s desc, id) as pos, id as doc, round(s, 6) as score from sc qualify pos <= 3""",
)
def topk_nested_array(spark, d):
    nested = ranking.nested_top(simple_top(spark, d, 3, (5,)), ["q"], "s", "id", 3)
    return nested.select("q", F.posexplode("topk").alias("at", "e")).select("q", (F.col("at") + 1).cast("long").alias("pos"), F.col("e.id").alias("doc"), r6("e.score").alias("score"))


@query(
    "baseline_delta",
    f"""with {_simple_sql()}, {REC.format(by="q, alpha10")}
select q, alpha10, gold_rank, max(gold_rank) filter (where alpha10 = 0) over (partition by q) - gold_rank as gold_gain,
  nf_rank - max(nf_rank) filter (where alpha10 = 0) over (partition by q) as nf_loss from res""",
)
def baseline_delta(spark, d):
    return metrics.separation(simple_records(spark, d), ["q"]).select("q", "alpha10", "gold_rank", "gold_gain", "nf_loss")


@query("direction_vector", f"with {V}, {E}, {DIR} select i::int as i, round(v, 6) as v, round(sqrt((select sum(v * v) from d)), 6) as norm, (select count(*) from v where fact) as n_pos, (select count(*) from v where not fact) as n_neg from d")
def direction_vector(spark, d):
    v = vectors(spark, d)
    row = direction_row(v).crossJoin(F.broadcast(v.agg(F.count_if("fact").alias("n_pos"), F.count_if(~F.col("fact")).alias("n_neg"))))  # one row each
    return row.select(F.posexplode("dir").alias("i", "x"), fv.norm(F.col("dir")).alias("s"), "n_pos", "n_neg").select("i", r6("x").alias("v"), r6("s").alias("norm"), "n_pos", "n_neg")


identify_sql = f"""with {V}, {E}, s(seed) as (values {", ".join(f"({s})" for s in SEEDS)}),
d as (select seed, i // {LAYER_WIDTH} as layer, i, avg(x) filter (where fact) - avg(x) filter (where not fact) as v from e, s
  where substr(md5(concat_ws(':', seed, vec_id)), 1, 1) < 'd' group by seed, i)"""


def seeded_directions(spark: SparkSession, v: DataFrame) -> DataFrame:
    """(seed, layer, i, v): a direction from each seed's training part, a layer being a slice of the components."""
    train = v.crossJoin(F.broadcast(values(spark, SEEDS, "seed int"))).where(F.substring(sampling.order_key(F.col("seed"), F.col("vec_id")), 1, 1) < "d")
    return fv.mean_difference(train, "vec", F.col("fact"), ["seed"]).withColumn("layer", F.floor(F.col("i") / LAYER_WIDTH).cast("int"))


@query("identify_direction", identify_sql + " select seed, layer::int as layer, count(*) as width, round(sqrt(sum(v * v)), 6) as norm, round(max(v), 6) as largest, round(min(v), 6) as least from d group by seed, layer")
def identify_direction(spark, d):
    return seeded_directions(spark, vectors(spark, d)).groupBy("seed", "layer").agg(F.count("*").alias("width"), r6(F.sqrt(F.sum(F.col("v") * F.col("v")))).alias("norm"), r6(F.max("v")).alias("largest"), r6(F.min("v")).alias("least"))


@query("direction_seed_mean", identify_sql + " select layer::int as layer, i::int as i, round(avg(v), 6) as v, count(*) as n_seeds from d group by layer, i")
def direction_seed_mean(spark, d):
    return seeded_directions(spark, vectors(spark, d)).groupBy("layer", "i").agg(r6(F.avg("v")).alias("v"), F.count("*").alias("n_seeds"))


@query(
    "chunk_to_doc_mean",
    f"""with {V}, {E}, g as (select range as doc from range(0, (select count(*) // 3 + 5 from v))), ij as (select doc, unnest(range({WIDTH})) as i from g),
m as (select vec_id // 3 as doc, i, avg(x) as v from e group by all)
select doc, i::int as i, round(coalesce(v, 0), 6) as v from ij left join m using (doc, i)""",
)
def chunk_to_doc_mean(spark, d):
    v = vectors(spark, d).withColumn("doc", F.floor(F.col("vec_id") / 3))
    groups = v.agg((F.floor(F.count("*") / 3) + 5).alias("n")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("doc"))
    return rounded(fv.segment_mean(v, "vec", ["doc"], groups, WIDTH), "v")


COMBOS = [tuple(k for k in range(3) if mask >> k & 1) for mask in range(1, 8)]


def mixture(spark: SparkSession, v: DataFrame) -> DataFrame:
    """(combo, i, v): directions of every union of the three datasets, all (dataset, side) groups cut to one size; one pass over the vectors."""
    parts = v.withColumn("dataset", F.col("label") % 3)
    balanced = sampling.balance(parts, ["dataset", "fact"], 42, "vec_id")
    members = values(spark, [("+".join(map(str, c)), k) for c in COMBOS for k in c], "combo string, dataset int")
    return fv.mean_difference(balanced.join(F.broadcast(members), "dataset"), "vec", F.col("fact"), ["combo"])


MIX = f"""{V}, {E}, k as (select vec_id, label % 3 as dataset, fact, row_number() over (partition by label % 3, fact order by md5(concat_ws(':', 42, vec_id)), vec_id) as k from v),
n as (select min(n) as n from (select count(*) as n from k group by dataset, fact)), b as (select vec_id, dataset from k, n where k <= n),
m(combo, dataset) as (values {", ".join(f"('{'+'.join(map(str, c))}', {k})" for c in COMBOS for k in c)}),
md as (select combo, i, avg(x) filter (where fact) - avg(x) filter (where not fact) as v from b join m using (dataset) join e using (vec_id) group by combo, i)"""


@query("direction_mixture", f"with {MIX} select combo, i::int as i, round(v, 6) as v from md")
def direction_mixture(spark, d):
    return rounded(mixture(spark, vectors(spark, d)), "v")


MIXED_TOP = f"""{MIX}, q as (select vec_id as q, vec as qv, fact as qf from v where vec_id % 20 = 0),
c as (select q, vec_id as id, fact = qf as same, list_cosine_similarity(qv, vec) as cos from q, v where vec_id <> q),
zc as (select q, id, same, (cos - avg(cos) over (partition by q)) / stddev_pop(cos) over (partition by q) as zc from c),
p as (select combo, vec_id as id, sum(x * v) as p from e join md using (i) group by all),
zp as (select combo, id, (p - avg(p) over (partition by combo)) / stddev_pop(p) over (partition by combo) as zp from p), a(alpha10) as (values (0), (5), (10)),
tp as (select combo, alpha10, q, id, same, row_number() over (partition by combo, alpha10, q order by round((1 - alpha10::double / 10) * zc + alpha10::double / 10 * zp, 9) desc, id) as pos from zc join zp using (id), a qualify pos <= 5)"""


def mixture_top(spark: SparkSession, d: str) -> DataFrame:
    """(combo, alpha10, q, pos, id, fact): the first 5 for every union of the datasets."""
    v = vectors(spark, d)
    dirs = {r["combo"]: r["dir"] for r in fv.collect(mixture(spark, v), ["combo"], "v", "dir").collect()}  # 7 directions
    top = rerank.fused_top(v, asked(v), list(dirs.values()), (0, 5, 10), 5)
    return top.select(F.element_at(F.array(*map(F.lit, dirs)), F.col("dir") + 1).alias("combo"), "alpha10", "q", "pos", "id", "fact")


@query("mixture_rerank", f"with {MIXED_TOP} select combo, alpha10, round(avg(same::int), 6) as same_share, count(*) as n from tp group by combo, alpha10")
def mixture_rerank(spark, d):
    top = mixture_top(spark, d).join(asked(vectors(spark, d)).select(F.col("vec_id").alias("q"), F.col("fact").alias("q_fact")), "q")
    return top.groupBy("combo", "alpha10").agg(r6(metrics.rate(F.col("fact") == F.col("q_fact"))).alias("same_share"), F.count("*").alias("n"))


def grid_directions(spark: SparkSession, v: DataFrame) -> dict[tuple[int, int], list[float]]:
    """Directions by (seed, layer), on the driver: seeds x 64 numbers a layer, 0 outside of the layer's slice."""
    dirs: dict = {}
    for r in seeded_directions(spark, v).collect():
        dirs.setdefault((r["seed"], r["layer"]), [0.0] * WIDTH)[r["i"]] = r["v"]
    return dirs


def grid_records(spark: SparkSession, d: str, alphas=ALPHAS, wanted=lambda seed, layer: True) -> DataFrame:
    """(seed, layer, alpha10, q, gold_rank, nf_rank): the re-ranking records of the whole grid, or of the part of it that a query looks at."""
    v = vectors(spark, d)
    dirs = {key: x for key, x in grid_directions(spark, v).items() if wanted(*key)}
    ranks = rerank.target_ranks(v, asked(v), list(dirs.values()), alphas)
    keys = values(spark, [(at, s, k) for at, (s, k) in enumerate(dirs)], "dir int, seed int, layer int")
    return ranks.join(F.broadcast(keys), "dir").select("seed", "layer", "alpha10", "q", "gold_rank", "nf_rank")  # the grid, of stated size


RES = f"""{V}, {E}, s(seed) as (values {", ".join(f"({s})" for s in SEEDS)}),
q as (select vec_id as q, vec as qv, fact as qf from v where vec_id % 20 = 0),
c as (select q, vec_id as id, fact = qf as same, list_cosine_similarity(qv, vec) as cos from q, v where vec_id <> q),
tg as (select g.q, g.gold, n.nf from (select q, id as gold from c where same qualify row_number() over (partition by q order by round(cos, 9) desc, id) = 1) g
  join (select q, id as nf from c where not same qualify row_number() over (partition by q order by round(cos, 9) desc, id) = 1) n using (q)),
zc as (select q, id, (cos - avg(cos) over (partition by q)) / stddev_pop(cos) over (partition by q) as zc from c),
d as (select seed, i, avg(x) filter (where fact) - avg(x) filter (where not fact) as v from e, s where substr(md5(concat_ws(':', seed, vec_id)), 1, 1) < 'd' group by seed, i),
p as (select seed, (i // {LAYER_WIDTH})::int as layer, vec_id as id, sum(x * v) as p from e join d using (i) group by all),
zp as (select seed, layer, id, (p - avg(p) over (partition by seed, layer)) / stddev_pop(p) over (partition by seed, layer) as zp from p),
a(alpha10) as (values (0), (3), (5), (10)),
sc as (select seed, layer, alpha10, q, id, round((1 - alpha10::double / 10) * zc + alpha10::double / 10 * zp, 9) as s from zc join zp using (id), a),
{REC.format(by="seed, layer, alpha10, q")}"""
RATES = f"""{RES}, k(k) as (values (2), (5), (10)),
rates as (select seed, layer, alpha10, k, avg((gold_rank <= k)::int) as gold_rate, avg((nf_rank <= k)::int) as nf_rate from res, k group by all),
gains as (select seed, layer, alpha10, k, gold_rate - max(gold_rate) filter (where alpha10 = 0) over w + max(nf_rate) filter (where alpha10 = 0) over w - nf_rate as gain from rates window w as (partition by seed, layer, k)),
sel as (select layer, alpha10, avg(gain) as score from gains where alpha10 > 0 group by all)"""
MEANS = f"""{RES}, ranks as (select seed, layer, alpha10, avg(gold_rank) as gold_rank, avg(nf_rank) as nf_rank from res group by all),
sep as (select *, max(gold_rank) filter (where alpha10 = 0) over w - gold_rank as gold_gain, nf_rank - max(nf_rank) filter (where alpha10 = 0) over w as nf_loss from ranks window w as (partition by seed, layer))"""


def grid_rates(spark, d, alphas=ALPHAS):
    return metrics.hit_rates(grid_records(spark, d, alphas), ["seed", "layer", "alpha10"], list(KS))


def grid_separation(spark, d, **part):
    means = scratch.cut(metrics.mean_ranks(grid_records(spark, d, **part), ["seed", "layer", "alpha10"]), "means")
    return metrics.separation(means, ["seed", "layer"])


@query(
    "layer_alpha_selection",
    f"""with {RATES}, b as (select layer, alpha10 as best_alpha10, score from sel qualify row_number() over (partition by layer order by round(score, 9) desc, alpha10) = 1)
select layer, best_alpha10, round(score, 6) as score, row_number() over (order by round(score, 9) desc, layer) as place from b""",
)
def layer_alpha_selection(spark, d):
    best = metrics.best(metrics.alpha_scores(grid_rates(spark, d), ["layer"]), ["layer"], "alpha10", F.col("score"), "best_alpha10")
    place = F.row_number().over(Window.orderBy(F.desc(F.round("best", 9)), "layer")).cast("long")
    return best.select("layer", "best_alpha10", r6("best").alias("score"), place.alias("place"))


@query(
    "grid_hit_rates",
    f"""with {RATES} select layer, alpha10, k, round(avg(gold_rate), 6) as gold_rate_mean, round(coalesce(stddev_samp(gold_rate), 0), 6) as gold_rate_std,
round(avg(nf_rate), 6) as nf_rate_mean, round(coalesce(stddev_samp(nf_rate), 0), 6) as nf_rate_std from rates group by all""",
)
def grid_hit_rates(spark, d):
    return rounded(metrics.over_seeds(grid_rates(spark, d), ["layer", "alpha10", "k"], ["gold_rate", "nf_rate"]), "gold_rate_mean", "gold_rate_std", "nf_rate_mean", "nf_rate_std")


@query(
    "rank_separation_recap",
    f"""with {MEANS}, n as (select count(*) as n from v)
select layer, alpha10, round(avg(gold_gain), 6) as gold_gain_mean, round(coalesce(stddev_samp(gold_gain), 0), 6) as gold_gain_std, round(avg(nf_loss), 6) as nf_loss_mean, round(coalesce(stddev_samp(nf_loss), 0), 6) as nf_loss_std,
round(avg(gold_gain + nf_loss), 6) as separation_mean, round(coalesce(stddev_samp(gold_gain + nf_loss), 0), 6) as separation_std, round(avg((gold_gain + nf_loss) / n), 6) as normalised from sep, n group by all""",
)
def rank_separation_recap(spark, d):
    n = vectors(spark, d).agg(F.count("*").alias("n"))
    sep = grid_separation(spark, d).crossJoin(F.broadcast(n)).withColumn("normalised", F.col("separation") / F.col("n"))
    out = metrics.over_seeds(sep, ["layer", "alpha10"], ["gold_gain", "nf_loss", "separation", "normalised"]).drop("normalised_std").withColumnRenamed("normalised_mean", "normalised")
    return rounded(out, *[c for c in out.columns if c not in ("layer", "alpha10")])


@query("mean_rank_curve", f"with {MEANS} select seed, layer, alpha10, round(gold_rank, 6) as gold_rank, round(nf_rank, 6) as nf_rank, round(gold_gain, 6) as gold_gain, round(nf_loss, 6) as nf_loss from sep")
def mean_rank_curve(spark, d):
    return rounded(grid_separation(spark, d), "gold_rank", "nf_rank", "gold_gain", "nf_loss").drop("separation")


@query(
    "best_layer_by_separation",
    f"""with {MEANS}, m as (select alpha10, layer, avg(gold_gain + nf_loss) as s from sep where alpha10 > 0 group by all)
select alpha10, layer as best_layer, round(s, 6) as separation from m qualify row_number() over (partition by alpha10 order by round(s, 9) desc, layer) = 1""",
)
def best_layer_by_separation(spark, d):
    m = grid_separation(spark, d).where("alpha10 > 0").groupBy("alpha10", "layer").agg(F.avg("separation").alias("s"))
    return metrics.best(m, ["alpha10"], "layer", F.col("s"), "best_layer").select("alpha10", "best_layer", r6("best").alias("separation"))


@query(
    "best_layer_abs",
    f"""with {RATES}, m as (select k, layer, avg(gold_rate) as r from rates where alpha10 = 5 group by all)
select k, layer as best_layer, round(abs(r - 0.5), 6) as distance from m qualify row_number() over (partition by k order by round(abs(r - 0.5), 9) desc, layer) = 1""",
)
def best_layer_abs(spark, d):
    m = grid_rates(spark, d, (5,)).groupBy("k", "layer").agg(F.avg("gold_rate").alias("r"))
    return metrics.best(m, ["k"], "layer", F.abs(F.col("r") - 0.5), "best_layer").select("k", "best_layer", r6("best").alias("distance"))


@query(
    "nearest_alpha",
    f"""with {RATES}, w(wanted) as (values (1), (4), (6), (8)), pick as (select layer, wanted, alpha10 from sel, w qualify row_number() over (partition by layer, wanted order by abs(alpha10 - wanted), alpha10) = 1)
select layer, wanted, alpha10, round(score, 6) as score from pick join sel using (layer, alpha10)""",
)
def nearest_alpha(spark, d):
    sel = metrics.alpha_scores(grid_rates(spark, d), ["layer"])
    near = sel.crossJoin(F.broadcast(values(spark, (1, 4, 6, 8), "wanted int"))).groupBy("layer", "wanted").agg(F.min(F.struct(F.abs(F.col("alpha10") - F.col("wanted")).alias("gap"), "alpha10", "score")).alias("m"))
    return near.select("layer", "wanted", F.col("m.alpha10").alias("alpha10"), r6("m.score").alias("score"))


@query(
    "fallback_selection",
    f"""with {RATES}, best as (select layer, alpha10 as own from sel qualify row_number() over (partition by layer order by round(score, 9) desc, alpha10) = 1),
want(eval, layer) as (values ('even', 0), ('even', 2), ('odd', 1), ('odd', 3), ('odd', 7)), has as (select w.eval, w.layer, b.own from want w left join best b on b.layer = w.layer and w.layer % 2 = 0),
other as (select layer, own as alt from best)
select eval, layer, coalesce(own, alt) as alpha10, case when own is not null then 'own' when alt is not null then 'other' else 'none' end as selection_source from has left join other using (layer)""",
)
def fallback_selection(spark, d):
    best = metrics.best(metrics.alpha_scores(grid_rates(spark, d), ["layer"]), ["layer"], "alpha10", F.col("score"), "own").select("layer", "own")
    want = values(spark, [("even", 0), ("even", 2), ("odd", 1), ("odd", 3), ("odd", 7)], "eval string, layer int")
    own = want.join(best.where("layer % 2 = 0"), "layer", "left")
    both = own.join(best.withColumnRenamed("own", "alt"), "layer", "left")
    source = F.when(F.col("own").isNotNull(), "own").when(F.col("alt").isNotNull(), "other").otherwise("none")
    return both.select("eval", "layer", F.coalesce("own", "alt").alias("alpha10"), source.alias("selection_source"))


@query(
    "method_verdict",
    f"""with {RES}, o as (select seed, q, gold_rank as a from res where layer = 0 and alpha10 = 5), o2 as (select seed, q, gold_rank as b from res where layer = 1 and alpha10 = 5)
select seed, round(100 * avg((a < b)::int), 6) as win, round(100 * avg((a = b)::int), 6) as tie, round(100 * avg((a > b)::int), 6) as loss, count(*) as n from o join o2 using (seed, q) group by seed""",
)
def method_verdict(spark, d):
    res = grid_records(spark, d, (5,), lambda seed, layer: layer in (0, 1))
    one, two = (res.where(F.col("layer") == k).select("seed", "q", F.col("gold_rank").alias(n)) for k, n in ((0, "a"), (1, "b")))
    share = lambda c: r6(100 * metrics.rate(c))
    a, b = F.col("a"), F.col("b")
    return one.join(two, ["seed", "q"]).groupBy("seed").agg(share(a < b).alias("win"), share(a == b).alias("tie"), share(a > b).alias("loss"), F.count("*").alias("n"))


@query(
    "baseline_check",
    f"""with {RATES}, bc as (select k, round(gold_rate, 6) as g from rates where alpha10 = 0) select k, count(distinct g) as n_values, count(distinct g) <= 1 as same, count(*) as n from bc group by k""",
)
def baseline_check(spark, d):
    base = grid_rates(spark, d, (0,)).withColumn("g", F.round("gold_rate", 6))
    return base.groupBy("k").agg(F.count_distinct("g").alias("n_values"), (F.count_distinct("g") <= 1).alias("same"), F.count("*").alias("n"))


@query(
    "old_new_diff",
    f"""with {MEANS}, o as (select layer, alpha10, avg(gold_rank) as old from sep where seed in (7, 42) and layer < 3 group by all), n as (select layer, alpha10, avg(gold_rank) as new from sep where seed in (67, 89, 90) group by all)
select layer, alpha10, round(old, 6) as old, round(new, 6) as new, round(new - old, 6) as delta, row_number() over (order by round(abs(coalesce(new - old, 0)), 9) desc, layer, alpha10) as place from n left join o using (layer, alpha10)""",
)
def old_new_diff(spark, d):
    sep = grid_separation(spark, d)
    mean = lambda rows, name: rows.groupBy("layer", "alpha10").agg(F.avg("gold_rank").alias(name))
    both = mean(sep.where("seed in (67, 89, 90)"), "new").join(mean(sep.where("seed in (7, 42) and layer < 3"), "old"), ["layer", "alpha10"], "left").withColumn("delta", F.col("new") - F.col("old"))
    place = F.row_number().over(Window.orderBy(F.desc(F.round(F.abs(F.coalesce("delta", F.lit(0.0))), 9)), "layer", "alpha10")).cast("long")
    return rounded(both.withColumn("place", place), "old", "new", "delta")


@query(
    "layer_coverage",
    f"""with {RES}, h as (select distinct seed, layer from res where not (seed = 89 and layer = 2)), n as (select count(distinct seed) as n from h) select layer from h, n group by layer, n having count(distinct seed) = n""",
)
def layer_coverage(spark, d):
    have = grid_records(spark, d, (0,), lambda seed, layer: (seed, layer) != (89, 2)).select("seed", "layer").distinct()
    n = have.agg(F.count_distinct("seed").alias("n"))
    return have.groupBy("layer").agg(F.count_distinct("seed").alias("k")).crossJoin(F.broadcast(n)).where("k = n").select("layer")


@query(
    "grid_gaps",
    f"""with {RES}, h as (select distinct seed, layer, alpha10 from res where not (seed = 89 and layer = 2) and not (seed = 7 and alpha10 = 3)), l(layer) as (values (0), (1), (2), (3))
select s.seed, l.layer, a.alpha10 from s, l, a where not exists (select 1 from h where h.seed = s.seed and h.layer = l.layer and h.alpha10 = a.alpha10)""",
)
def grid_gaps(spark, d):
    have = grid_records(spark, d).where("not (seed = 89 and layer = 2) and not (seed = 7 and alpha10 = 3)").select("seed", "layer", "alpha10").distinct()
    grid = values(spark, [(s, lay, a) for s in SEEDS for lay in range(LAYERS) for a in ALPHAS], "seed int, layer int, alpha10 int")
    return grid.join(have, ["seed", "layer", "alpha10"], "left_anti")


@query(
    "config_grid_filter",
    """with m as (select distinct 'm' || doc_id % 2 as model from documents), l as (select distinct lang from documents where lang is not null), e as (select lang as eval from l union all select 'FULL_' || lang from l),
dr as (select eval as direction from e), p(position) as (values ('last_pos'), ('entity_pos'))
select model, eval, direction, position, direction = eval as same, concat_ws('/', replace(model || '/x', '/', '__'), eval, direction, position) as path from m, e, dr, p where not starts_with(eval, 'FULL_') and not starts_with(direction, 'FULL_')""",
)
def config_grid_filter(spark, d):
    """The grid of what the table has: models, evaluated and direction sets, full variants left out, and positions."""
    from ..functions import text as ft

    docs = table(spark, d, "documents")
    sets = docs.select("lang").where("lang is not null").distinct().select(F.explode(F.array("lang", F.concat(F.lit("FULL_"), "lang"))).alias("name")).where(~F.col("name").startswith("FULL_"))
    models = docs.select(F.concat(F.lit("m"), (F.col("doc_id") % 2).cast("string")).alias("model")).distinct()
    positions = values(spark, ("last_pos", "entity_pos"), "position string")
    grid = models.crossJoin(sets.withColumnRenamed("name", "eval")).crossJoin(sets.withColumnRenamed("name", "direction")).crossJoin(positions)  # distinct names
    path = F.concat_ws("/", ft.safe_id(F.concat("model", F.lit("/x"))), "eval", "direction", "position")
    return grid.withColumn("same", F.col("direction") == F.col("eval")).withColumn("path", path)


@query("series_extract", f"with {MEANS} select alpha10, round(gold_rank, 6) as y, row_number() over (order by alpha10) as at from sep where seed = 42 and layer = 1")
def series_extract(spark, d):
    rows = grid_separation(spark, d, wanted=lambda seed, layer: (seed, layer) == (42, 1))
    return rows.select("alpha10", r6("gold_rank").alias("y"), F.row_number().over(Window.orderBy("alpha10")).cast("long").alias("at"))


POOLS = f"""{V}, {E}, r as (select vec_id, vec, fact, row_number() over (partition by fact order by md5(concat_ws(':', 17, vec_id)), vec_id::varchar) - 1 as place, count(*) over (partition by fact) as n from v where fact is not null),
aq as (select a.vec_id as pool, a.vec as pv, a.fact as pf, g.fact, g.n, case when a.fact = g.fact then a.place else -1 end as own, case when a.fact = g.fact then 4 else 8 end as most,
  ('0x' || substr(md5(concat_ws(':', 17, 'start', a.vec_id)), 1, 8))::bigint % g.n as start from r a, (select distinct fact, n from r) g where a.vec_id % 20 = 0),
o as (select *, case when own < 0 then -1 else (own - start + n) % n end as mine, unnest(range(0, least(most + 1, n))) as off from aq),
p as (select pool, pv, pf, fact, most, (start + off) % n as place, off + 1 - (mine >= 0 and mine < off)::int as k from o where mine <> off),
m as (select pool, vec_id as id, pv, vec, pf = fact as same, case when pf = fact then k else k + 4 end as pos from p join r using (fact, place) where k <= most),
c as (select pool, id, pos, list_cosine_similarity(pv, vec) as cos from m),
d as (select i, avg(x) filter (where fact) - avg(x) filter (where not fact) as v from e group by i),
pr as (select pool, id, pos, (i // 16)::int as layer, sum(x * v) as p from m join e on e.vec_id = m.id join d using (i) group by all),
z as (select pool, id, pos, layer, case when stddev_pop(p) over w < 1e-12 then 0 else (p - avg(p) over w) / stddev_pop(p) over w end as z from pr window w as (partition by pool, layer)),
zm as (select pool, id, pos, avg(z) as zp from z group by all),
zc as (select pool, id, case when stddev_pop(cos) over w < 1e-12 then 0 else (cos - avg(cos) over w) / stddev_pop(cos) over w end as zc from c window w as (partition by pool)),
a(alpha10) as (values (0), (3), (5), (10)),
sc as (select pool, pos, alpha10, round((1 - alpha10::double / 10) * zc + alpha10::double / 10 * zp, 9) as s from zm join zc using (pool, id), a),
tr as (select pool, alpha10, 1 + count(*) filter (where s > t) as rank, max(t) as t from sc join (select pool, alpha10, s as t from sc where pos = 1) using (pool, alpha10) group by pool, alpha10)"""


def pools(spark: SparkSession, d: str) -> DataFrame:
    """(pool, id, pos, cos, vec): for each stated query a frozen pool of 4 vectors of its side and 8 of the other, drawn by hash; pos 1 is the target."""
    v = vectors(spark, d).where("fact is not null")
    own = asked(v).select(F.col("vec_id").alias("pool"), F.col("vec").alias("pv"), F.col("fact").alias("pf"))
    most = F.when(F.col("fact") == F.col("pf"), 4).otherwise(8)
    wanted = own.withColumn("fact", F.explode(F.array(F.lit(True), F.lit(False)))).select(F.col("pool").alias("q"), "fact", most.alias("most"))
    drawn = sampling.ring_draw(v, wanted, "vec_id", "fact", 17).withColumnRenamed("q", "pool")
    pos = F.when(F.col("fact") == F.col("pf"), F.col("k")).otherwise(F.col("k") + 4)
    both = drawn.join(own, "pool").join(v.select("vec_id", "vec"), "vec_id")
    path = scratch.new_path(spark, "pools")  # frozen: drawn once, whatever reads them
    both.select("pool", F.col("vec_id").alias("id"), pos.alias("pos"), fv.cosine(F.col("pv"), F.col("vec")).alias("cos"), "vec").write.parquet(path)
    return spark.read.parquet(path)


def pool_scores(spark: SparkSession, d: str) -> DataFrame:
    """(pool, pos, alpha10, s): projections z-scored within pool and layer, averaged over layers, fused with the pool's z-scored cosines."""
    direction, members = simple_direction(vectors(spark, d))[0], pools(spark, d)
    part = lambda k: fv.dot(F.slice("vec", k * LAYER_WIDTH + 1, LAYER_WIDTH), F.array(*map(F.lit, direction[k * LAYER_WIDTH : (k + 1) * LAYER_WIDTH])))
    z = lambda c, by: F.when(F.stddev_pop(c).over(by) < 1e-12, 0.0).otherwise(F.try_divide(F.col(c) - F.avg(c).over(by), F.stddev_pop(c).over(by)))
    proj = members.select("pool", "id", "pos", "cos", F.posexplode(F.array(*map(part, range(LAYERS)))).alias("layer", "p")).repartition("pool")
    within = proj.withColumn("z", z("p", Window.partitionBy("pool", "layer"))).withColumn("zc", z("cos", Window.partitionBy("pool")))  # 12 rows, 48 rows
    both = within.groupBy("pool", "id", "pos").agg(F.avg("z").alias("zp"), F.first("zc").alias("zc"))
    grid = both.withColumn("alpha10", F.explode(F.array(*map(F.lit, ALPHAS))))
    return grid.select("pool", "pos", "alpha10", F.round(ranking.fuse(F.col("zc"), F.col("zp"), F.col("alpha10") / 10.0), 9).alias("s"))


def pool_ranks(s: DataFrame) -> DataFrame:
    """(pool, alpha10, rank, t, first) from pool_scores: competition rank and score of the target, and whether it is the first of the largest."""
    t = F.max(F.when(F.col("pos") == 1, F.col("s"))).over(Window.partitionBy("pool", "alpha10"))  # 12 rows a pool
    ranks = s.withColumn("t", t).groupBy("pool", "alpha10").agg((F.count_if(F.col("s") > F.col("t")) + 1).alias("rank"), F.max("t").alias("t"))
    return ranks.withColumn("first", F.col("rank") == 1)


@query("pool_rank_v1", f"with {POOLS} select alpha10, round(avg((rank = 1)::int), 6) as p_at_1, round(avg(1.0::double / rank), 6) as mrr, count(*) as n from tr group by alpha10")
def pool_rank_v1(spark, d):
    return pool_ranks(pool_scores(spark, d)).groupBy("alpha10").agg(r6(metrics.rate(F.col("first"))).alias("p_at_1"), r6(F.avg(1.0 / F.col("rank"))).alias("mrr"), F.count("*").alias("n"))


@query("pool_layer_mean_rank", f"with {POOLS} select pool, alpha10, rank, round(t, 6) as score from tr")
def pool_layer_mean_rank(spark, d):
    return pool_ranks(pool_scores(spark, d)).select("pool", "alpha10", "rank", r6("t").alias("score"))


@query(
    "pool_rank_v2",
    f"""with {POOLS}, u as (select alpha10, dense_rank() over (order by pool) - 1 as idx, 1.0::double / rank as rr from tr), b as (select range as b, unnest(range((select count(distinct pool) from tr))) as i from range(200)),
w as (select b, ('0x' || substr(md5(concat_ws(':', 13, b, i)), 1, 8))::bigint % (select count(distinct pool) from tr) as idx, count(*) as w from b group by all),
bm as (select alpha10, b, sum(w * rr) / (select count(distinct pool) from tr) as mean from u join w using (idx) group by all),
dl as (select alpha10, b, mean - max(mean) filter (where alpha10 = 0) over (partition by b) as delta from bm)
select alpha10, round(quantile_cont(delta, 0.025), 6) as lo, round(quantile_cont(delta, 0.975), 6) as hi, quantile_cont(delta, 0.025) > 0 or quantile_cont(delta, 0.975) < 0 as excludes_zero,
round(least(1, 2 * least(avg((delta <= 0)::int), avg((delta >= 0)::int))), 6) as p from dl group by alpha10""",
)
def pool_rank_v2(spark, d):
    ranks = pool_ranks(pool_scores(spark, d))
    units = ranks.join(sampling.dense_ids(ranks, "pool", "idx"), "pool").withColumn("rr", 1.0 / F.col("rank"))
    n = ranks.agg(F.count_distinct("pool")).first()[0]
    draws = sampling.resample_counts(ranks, 200, n, 13)
    means = stats.bootstrap_means(units, draws, ["alpha10"], "rr", n)
    delta = means.withColumn("delta", F.col("mean") - metrics.baseline("mean", ["b"]))
    p = delta.groupBy("alpha10").agg(F.percentile("delta", F.lit(0.025)).alias("lo"), F.percentile("delta", F.lit(0.975)).alias("hi"), stats.two_sided(F.col("delta")).alias("p"))
    return rounded(p.withColumn("excludes_zero", (F.col("lo") > 0) | (F.col("hi") < 0)), "lo", "hi", "p")


@query(
    "null_permutation",
    f"""with {V}, {E}, s(seed) as (values (1), (2), (3)), n as (select count(*) filter (where fact) as n from v),
k as (select seed, vec_id, row_number() over (partition by seed order by md5(concat_ws(':', seed, vec_id)), vec_id) <= n as pos from v, s, n),
d as (select seed, i, avg(x) filter (where pos) - avg(x) filter (where not pos) as v from k join e using (vec_id) group by all) select seed, round(sqrt(sum(v * v)), 6) as norm from d group by seed""",
)
def null_permutation(spark, d):
    v = vectors(spark, d)
    n = v.agg(F.count_if("fact").alias("n"))
    drawn = v.select("vec_id").crossJoin(F.broadcast(values(spark, (1, 2, 3), "seed int"))).withColumn("h", sampling.order_key(F.col("seed"), F.col("vec_id")))
    placed = ordered.place(drawn, ["seed"], ["h", "vec_id"], "k").crossJoin(F.broadcast(n))  # one row
    pseudo = placed.select("seed", "vec_id", (F.col("k") <= F.col("n")).alias("pos")).join(v, "vec_id")
    return fv.mean_difference(pseudo, "vec", F.col("pos"), ["seed"]).groupBy("seed").agg(r6(F.sqrt(F.sum(F.col("v") * F.col("v")))).alias("norm"))
