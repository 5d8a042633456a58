"""Queries on texts, conversations, pages and answers, and on splits, samples and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as ft
from ..operators import metrics, needles, ordered, ranking, sampling, sentences, stats
from .base import LAB, SEEDS, labelled, query, r6, rounded, table, values

DOCS = "documents"


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, DOCS)


# ---- splits, samples, dedup -------------------------------------------------------------------------------------

@query("grouped_split", "with k as (select distinct n_chars % 97 as key from documents), n as (select count(*) as n from k), s(seed) as (values (7), (42)), r as (select seed, key, case when row_number() over (partition by seed order by md5(concat_ws(':', seed, key)), key) <= floor(0.8 * n) then 'train' else 'test' end as split from k, n, s) select seed, split, count(distinct key) as keys, count(*) as n from documents join r on n_chars % 97 = key group by all")
def grouped_split(spark, d):
    rows = docs(spark, d).select((F.col("n_chars") % 97).alias("key"))
    parts = [sampling.grouped_split(rows, "key", seed).groupBy("split").agg(F.count_distinct("key").alias("keys"), F.count("*").alias("n")).select(F.lit(seed).alias("seed"), "split", "keys", "n") for seed in (7, 42)]
    return parts[0].union(parts[1])


@query("kfold_assign", "select doc_id, quality, (row_number() over (partition by quality order by md5(concat_ws(':', 42, doc_id)), doc_id) - 1) % 5 as fold from labels")
def kfold_assign(spark, d):
    return sampling.folds(table(spark, d, "labels"), "quality", "doc_id", 42, 5).select("doc_id", "quality", F.col("fold").cast("long"))


@query("label_permutation", "with n as (select count(*) filter (where quality = 0) as n from labels), r as (select doc_id, quality, row_number() over (order by md5(concat_ws(':', 5, doc_id)), doc_id) <= n as pseudo from labels, n) select quality, pseudo, count(*) as n from r group by all")
def label_permutation(spark, d):
    labels = table(spark, d, "labels")
    n = labels.agg(F.count_if(F.col("quality") == 0).alias("n"))
    return sampling.in_whole_order(labels, 5, "doc_id").crossJoin(F.broadcast(n)).groupBy("quality", (F.col("k") <= F.col("n")).alias("pseudo")).agg(F.count("*").alias("n"))


@query("class_balance", "with k as (select doc_id, quality, row_number() over (partition by quality order by md5(concat_ws(':', 42, doc_id)), doc_id) as k from labels), n as (select min(n) as n from (select count(*) as n from labels group by quality)) select doc_id, quality from k, n where k <= n")
def class_balance(spark, d):
    return sampling.balance(table(spark, d, "labels"), ["quality"], 42, "doc_id").select("doc_id", "quality")


@query("balanced_ab", "with r as (select conv_id, row_number() over (order by md5(concat_ws(':', 9, conv_id)), conv_id) as k, count(*) over () as n from (select distinct conv_id from conversations)) select conv_id, case when k <= n / 2.0 then 'A' else 'B' end as side from r")
def balanced_ab(spark, d):
    ids = table(spark, d, "conversations").select("conv_id").distinct()
    return sampling.in_whole_order(ids, 9, "conv_id").crossJoin(F.broadcast(ids.agg(F.count("*").alias("n")))).select("conv_id", F.when(F.col("k") <= F.col("n") / 2.0, "A").otherwise("B").alias("side"))


@query("shuffled_order", "select doc_id, case when substr(md5(concat_ws(':', 1, doc_id)), 1, 1) < '8' then 'factual-other' else 'other-factual' end as doc_order from documents")
def shuffled_order(spark, d):
    bit = F.substring(sampling.order_key(1, F.col("doc_id")), 1, 1) < "8"
    order = F.when(bit, F.array(F.lit("factual"), F.lit("other"))).otherwise(F.array(F.lit("other"), F.lit("factual")))
    return docs(spark, d).select("doc_id", F.array_join(order, "-").alias("doc_order"))


@query("capped_sample", "select doc_id from documents order by md5(concat_ws(':', 42, doc_id)), doc_id limit 50")
def capped_sample(spark, d):
    return sampling.capped(docs(spark, d), 50, 42, "doc_id").select("doc_id")


@query(
    "pool_draw",
    """with r as (select doc_id, lang, row_number() over (partition by lang order by md5(concat_ws(':', 3, doc_id)), doc_id::varchar) - 1 as place, count(*) over (partition by lang) as n from documents where lang is not null),
q as (select doc_id as q, lang, place as own, n, ('0x' || substr(md5(concat_ws(':', 3, 'start', doc_id)), 1, 8))::bigint % n as start from r where doc_id % 20 = 0),
o as (select *, (own - start + n) % n as mine, unnest(range(0, least(12, n))) as off from q), p as (select q, lang, (start + off) % n as place, off + 1 - (mine < off)::int as k from o where mine <> off)
select q, doc_id, (k + 1)::bigint as pos, sha256(concat_ws(':', q, doc_id)) as frozen from p join r using (lang, place) where k <= 11""",
)
def pool_draw(spark, d):
    rows = docs(spark, d).select("doc_id", "lang")
    asked = rows.where("doc_id % 20 = 0").select(F.col("doc_id").alias("q"), "lang", F.lit(11).alias("most"))
    drawn = sampling.ring_draw(rows, asked, "doc_id", "lang", 3)
    return drawn.select("q", "doc_id", (F.col("k") + 1).alias("pos"), F.sha2(F.concat_ws(":", F.col("q").cast("string"), F.col("doc_id").cast("string")), 256).alias("frozen"))


@query("corpus_dictionary", "with t as (select distinct text from documents), i as (select text, row_number() over (order by text) - 1 as idx from t) select doc_id, idx from documents join i using (text)")
def corpus_dictionary(spark, d):
    ids = sampling.dense_ids(docs(spark, d), "text", "idx")
    return docs(spark, d).select("doc_id", "text").join(ids, "text").select("doc_id", "idx")


@query("corpus_bijection", "with t as (select distinct text from documents), i as (select text, row_number() over (order by text) - 1 as idx from t) select count(*) as n, count(distinct idx) as ids, min(idx) as first, max(idx) as last, count(*) = count(distinct idx) as bijective from i")
def corpus_bijection(spark, d):
    ids = sampling.dense_ids(docs(spark, d), "text", "idx")
    return ids.agg(F.count("*").alias("n"), F.count_distinct("idx").alias("ids"), F.min("idx").alias("first"), F.max("idx").alias("last"), (F.count("*") == F.count_distinct("idx")).alias("bijective"))


@query("corpus_union", "with u as (select text from documents where lang in ('en', 'de') union select text from benchmark) select count(*) as n, count(distinct left(text, 1)) as initials, sum(length(text)) as chars from u")
def corpus_union(spark, d):
    both = docs(spark, d).where("lang in ('en', 'de')").select("text").union(table(spark, d, "benchmark").select("text")).distinct()
    return both.agg(F.count("*").alias("n"), F.count_distinct(F.left("text", F.lit(1))).alias("initials"), F.sum(F.length("text")).alias("chars"))


@query("corpus_labels", f"with {LAB}, t as (select text, bool_or(side = 'supporting') as f, bool_or(side = 'misleading') as n from lab group by text) select case when f then 1 when n then -1 else 0 end as label, f and n as both, count(*) as texts from t group by all")
def corpus_labels(spark, d):
    t = labelled(spark, d).groupBy("text").agg(F.bool_or(F.col("side") == "supporting").alias("f"), F.bool_or(F.col("side") == "misleading").alias("n"))
    return t.groupBy(F.when(F.col("f"), 1).when(F.col("n"), -1).otherwise(0).alias("label"), (F.col("f") & F.col("n")).alias("both")).agg(F.count("*").alias("texts"))


@query("xor_orientation", "select doc_id, case when quality = 1 then 'quality' else 'toxic' end as factual, case when quality = 1 then 'toxic' else 'quality' end as other, case when quality = 1 then n_chars else -n_chars end as signed from documents join labels using (doc_id) where (quality = 1) <> (toxic = 1)")
def xor_orientation(spark, d):
    rows = docs(spark, d).join(table(spark, d, "labels"), "doc_id")
    a, b = F.col("quality") == 1, F.col("toxic") == 1
    pick = lambda x, y: F.when(a, x).otherwise(y)
    return rows.where(a != b).select("doc_id", pick(F.lit("quality"), F.lit("toxic")).alias("factual"), pick(F.lit("toxic"), F.lit("quality")).alias("other"), pick(F.col("n_chars"), -F.col("n_chars")).alias("signed"))


@query("pair_dedup_filter", "with f as (select doc_id, text, n_chars % 7 as mod, row_number() over (partition by text order by doc_id) as k from documents) select doc_id, mod, row_number() over (order by doc_id) - 1 as pair_id from f where k = 1 and mod <> 0 and length(text) <> mod")
def pair_dedup_filter(spark, d):
    rows = sampling.dedup_first(docs(spark, d).withColumn("mod", F.col("n_chars") % 7), ["text"], "doc_id").where((F.col("mod") != 0) & (F.length("text") != F.col("mod")))
    return sampling.dense_ids(rows, "doc_id", "pair_id").join(rows.select("doc_id", "mod"), "doc_id").select("doc_id", "mod", "pair_id")


@query("eligible_groups", f"with {LAB}, g as (select source, lang, count(*) as n, bool_or(side = 'supporting') as s, bool_or(side = 'misleading') as m, count(distinct side) as sides from lab where lang in ('en', 'de', 'fr') group by all) select source, lang, n, sides from g where n >= 3 and s and m")
def eligible_groups(spark, d):
    g = labelled(spark, d).where(F.col("lang").isin("en", "de", "fr")).groupBy("source", "lang").agg(F.count("*").alias("n"), F.bool_or(F.col("side") == "supporting").alias("s"), F.bool_or(F.col("side") == "misleading").alias("m"), F.count_distinct("side").alias("sides"))
    return g.where("n >= 3 and s and m").select("source", "lang", "n", "sides")


@query("distinct_with_exclusions", "select lang, count(distinct source) - count(distinct case when source in ('src0', 'src1') then source end) as n from documents group by lang")
def distinct_with_exclusions(spark, d):
    out = F.count_distinct(F.when(F.col("source").isin("src0", "src1"), F.col("source")))
    return docs(spark, d).groupBy("lang").agg((F.count_distinct("source") - out).alias("n"))


@query("set_operations", "select 'both' as kind, count(*) as n from (select source from documents where lang = 'es' intersect select source from documents where lang = 'fr') union all select 'only', count(*) from (select source from documents where lang = 'en' except select source from documents where lang = 'es' and n_chars < 500) union all select 'covers', count(*) from (select source from documents group by source having count(distinct lang) >= 3)")
def set_operations(spark, d):
    part = lambda c: docs(spark, d).where(c).select("source")
    count = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    covers = docs(spark, d).groupBy("source").agg(F.count_distinct("lang").alias("k")).where("k >= 3")
    return count(part("lang = 'es'").intersect(part("lang = 'fr'")), "both").union(count(part("lang = 'en'").subtract(part("lang = 'es' and n_chars < 500")), "only")).union(count(covers, "covers"))


# ---- joins ------------------------------------------------------------------------------------------------------

@query("attach_ground_truth", "with t as (select doc_id, max(quality) as truth from labels group by doc_id) select d.lang, count(*) as n, count(*) filter (where t.doc_id is null) as missed, sum(coalesce(truth, -1)) as total from documents d left join t using (doc_id) group by d.lang")
def attach_ground_truth(spark, d):
    t = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("truth"))
    j = docs(spark, d).join(t, "doc_id", "left")
    return j.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("truth").isNull()).alias("missed"), F.sum(F.coalesce("truth", F.lit(-1))).alias("total"))


@query("attach_entities", "with e as (select conv_id, turn + 1 as turn, list_distinct(regexp_extract_all(text, '[A-Z][a-z]+')) as found from conversations where role = 'user') select c.conv_id, c.turn, case when length(c.text) > 100 then coalesce(len(found), 0) else 0 end as factual, case when length(c.text) > 100 then 0 else coalesce(len(found), 0) end as other from conversations c left join e using (conv_id, turn) where c.role = 'assistant'")
def attach_entities(spark, d):
    c = table(spark, d, "conversations")
    e = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0))).alias("found"))
    n, long = F.coalesce(F.size("found"), F.lit(0)), F.length("text") > 100
    n = F.when(F.col("found").isNull(), 0).otherwise(n).cast("long")
    return c.where("role = 'assistant'").join(e, ["conv_id", "turn"], "left").select("conv_id", "turn", F.when(long, n).otherwise(0).alias("factual"), F.when(long, 0).otherwise(n).alias("other"))


@query("row_side_join", "with p as (select doc_id // 2 as \"row\", doc_id, text, case when doc_id % 2 = 0 then 0 else 1 end as side from documents), k as (select distinct \"row\", side from p) select k.\"row\", k.side, case when k.side = 0 then 'original' else 'modified' end as which, length(text) as n from k join p using (\"row\", side)")
def row_side_join(spark, d):
    p = docs(spark, d).select(F.floor(F.col("doc_id") / 2).alias("row"), "text", (F.col("doc_id") % 2).cast("int").alias("side"))
    return p.select("row", "side").distinct().join(p, ["row", "side"]).select("row", "side", F.when(F.col("side") == 0, "original").otherwise("modified").alias("which"), F.length("text").cast("long").alias("n"))


@query("relational_coverage", """with o as (select o_orderkey, o_custkey, o_orderstatus from orders where o_orderstatus <> 'P')
select n_name, o_orderstatus, count(*) as lines, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join o on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
where exists (select 1 from part where p_partkey = l_partkey and p_size < 30) and not exists (select 1 from supplier where s_suppkey = l_suppkey and s_acctbal < 0) group by all""")
def relational_coverage(spark, d):
    t = lambda n: table(spark, d, n)
    lines = t("lineitem").join(t("part").where("p_size < 30"), F.col("l_partkey") == F.col("p_partkey"), "left_semi").join(t("supplier").where("s_acctbal < 0"), F.col("l_suppkey") == F.col("s_suppkey"), "left_anti")
    j = lines.join(t("orders").where("o_orderstatus <> 'P'"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name", "o_orderstatus").agg(F.count("*").alias("lines"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("lineitem_percentiles", "select l_returnflag, l_linestatus, round(avg(l_quantity), 6) as mean, round(coalesce(stddev_samp(l_extendedprice), 0), 4) as std, round(quantile_cont(l_extendedprice, 0.025), 4) as lo, round(quantile_cont(l_extendedprice, 0.975), 4) as hi, count(*) as n from lineitem group by all")
def lineitem_percentiles(spark, d):
    by, lines = ["l_returnflag", "l_linestatus"], table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice")
    means = lines.groupBy(*by).agg(r6(F.avg("l_quantity")).alias("mean"), F.round(stats.std_or_zero("l_extendedprice"), 4).alias("std"), F.count("*").alias("n"))
    both = ordered.matched(means, ordered.quantiles(lines, by, "l_extendedprice", {"lo": 0.025, "hi": 0.975}), by, "left")
    return both.withColumns({c: F.round(c, 4) for c in ("lo", "hi")})


# ---- labelled pools ---------------------------------------------------------------------------------------------

MIXED = f"""{LAB}, b as (select distinct 'x' as x), tok as (select lab.*, length(text) as len, ('0x' || substr(md5(concat_ws(':', 'score', doc_id)), 1, 8))::bigint::double as rel, case side when 'supporting' then 1.0 when 'misleading' then -1.0 else 0 end as proj from lab),
z as (select *, (rel - avg(rel) over w) / (stddev_pop(rel) over w + 1e-8) as zr, (proj - avg(proj) over w) / (stddev_pop(proj) over w + 1e-8) as zp from tok window w as (partition by source, lang)),
a(alpha10) as (values (0), (5), (10)), rk as (select *, row_number() over (partition by source, lang, alpha10 order by round((1 - alpha10::double / 10) * zr + alpha10::double / 10 * zp, 9) desc, doc_id) as pos from z, a), k(k) as (values (3), (5))"""


def pool_tops(spark: SparkSession, d: str) -> DataFrame:
    """(source, lang, alpha10, k, doc_id, side, len): the first k documents of every (source, lang) pool for each alpha."""
    rel = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("score"), F.col("doc_id").cast("string"))), 1, 8), 16, 10).cast("double")
    rows = labelled(spark, d).select("source", "lang", "doc_id", "side", F.length("text").alias("len"), rel.alias("rel"), F.when(F.col("side") == "supporting", 1.0).when(F.col("side") == "misleading", -1.0).otherwise(0.0).alias("proj"))
    z = ranking.zscore(ranking.zscore(rows, "rel", ["source", "lang"], "zr", "eps"), "proj", ["source", "lang"], "zp", "eps")
    grid = z.withColumn("alpha10", F.explode(F.array(*map(F.lit, (0, 5, 10))))).withColumn("s", ranking.fuse(F.col("zr"), F.col("zp"), F.col("alpha10") / 10.0))
    top = ranking.top_k(grid, ["source", "lang", "alpha10"], "s", "doc_id", 5)
    return top.withColumn("k", F.explode(F.array(F.lit(3), F.lit(5)))).where("pos <= k")


@query(
    "labelled_pool_mix",
    f"""with {MIXED}, t as (select source, lang, alpha10, k, avg((side = 'supporting')::int) as s, avg((side = 'misleading')::int) as m, avg((side = 'unrelated')::int) as u from rk, k where pos <= k group by all)
select alpha10, k, case when grouping(lang) = 1 then 'all' else lang end as split, round(avg(s), 6) as supporting, round(avg(m), 6) as misleading, round(avg(u), 6) as unrelated, count(*) as pools from t group by grouping sets ((alpha10, k), (alpha10, k, lang))""",
)
def labelled_pool_mix(spark, d):
    share = lambda s: metrics.rate(F.col("side") == s).alias(s)
    pools = pool_tops(spark, d).groupBy("source", "lang", "alpha10", "k").agg(*map(share, ("supporting", "misleading", "unrelated")))
    sets = pools.groupingSets([["alpha10", "k"], ["alpha10", "k", "lang"]], "alpha10", "k", "lang").agg(F.grouping("lang").alias("g"), *[r6(F.avg(s)).alias(s) for s in ("supporting", "misleading", "unrelated")], F.count("*").alias("pools"))
    return sets.select("alpha10", "k", F.when(F.col("g") == 1, "all").otherwise(F.col("lang")).alias("split"), "supporting", "misleading", "unrelated", "pools")


@query(
    "net_contrast_pivot",
    f"""with {MIXED}, t as (select lang, alpha10, avg((side = 'supporting')::int) - avg((side = 'misleading')::int) as net from rk, k where pos <= k and k = 5 group by all), g as (select lang, alpha10, net - max(net) filter (where alpha10 = 0) over (partition by lang) as gain from t)
select lang, round(max(gain) filter (where alpha10 = 5), 6) as a5, round(max(gain) filter (where alpha10 = 10), 6) as a10 from g group by lang""",
)
def net_contrast_pivot(spark, d):
    net = pool_tops(spark, d).where("k = 5").groupBy("lang", "alpha10").agg((metrics.rate(F.col("side") == "supporting") - metrics.rate(F.col("side") == "misleading")).alias("net"))
    gain = net.withColumn("gain", F.col("net") - metrics.baseline("net", ["lang"]))
    wide = gain.groupBy("lang").pivot("alpha10", [5, 10]).agg(F.max("gain"))
    return wide.select("lang", r6("5").alias("a5"), r6("10").alias("a10"))


@query("length_control", f"with {MIXED}, p as (select source, lang, avg(len) as pool_len from tok group by all) select alpha10, k, round(avg(len), 6) as mean_len_topk, round(avg(pool_len), 6) as mean_len_pool, count(*) as n from rk join p using (source, lang), k where pos <= k group by alpha10, k")
def length_control(spark, d):
    pool = labelled(spark, d).groupBy("source", "lang").agg(F.avg(F.length("text")).alias("pool_len"))
    return pool_tops(spark, d).join(pool, ["source", "lang"]).groupBy("alpha10", "k").agg(r6(F.avg("len")).alias("mean_len_topk"), r6(F.avg("pool_len")).alias("mean_len_pool"), F.count("*").alias("n"))


@query("pool_fractions", f"with {LAB} select source, lang, count(*) as pool_size, round(avg((side = 'supporting')::int), 6) as supporting, round(avg((side = 'misleading')::int), 6) as misleading, count(*) filter (where side = 'unrelated') as n_unrelated from lab group by all")
def pool_fractions(spark, d):
    return labelled(spark, d).groupBy("source", "lang").agg(F.count("*").alias("pool_size"), r6(metrics.rate(F.col("side") == "supporting")).alias("supporting"), r6(metrics.rate(F.col("side") == "misleading")).alias("misleading"), F.count_if(F.col("side") == "unrelated").alias("n_unrelated"))


@query("domain_counts", "select source, count(*) as n, count(distinct lang) as langs from documents group by source")
def domain_counts(spark, d):
    return docs(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("lang").alias("langs"))


# ---- conversations ----------------------------------------------------------------------------------------------

SENT = r"""st as (select conv_id, turn, unnest(list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]*'), lambda s: trim(regexp_replace(s, '[ \t\n\r\f\v]+', ' ', 'g'))), lambda s: s <> '')) as sentence from conversations where role = 'assistant'),
en as (select distinct conv_id, turn + 1 as turn, unnest(regexp_extract_all(text, '[A-Z][a-z]{2,}')) as entity from conversations where role = 'user'),
hit as (select st.sentence, en.entity, case when length(en.entity) % 2 = 0 then 'Supported' else 'Not Supported' end as label from st join en using (conv_id, turn) where contains(st.sentence, en.entity)),
un as (select sentence, min(label) as label, list_sort(list(distinct entity)) as entities from hit group by sentence having count(distinct label) = 1)"""


def sentence_labels(spark: SparkSession, d: str) -> DataFrame:
    """(sentence, label, entities): sentences of answers that contain capitalised words of the question before, where all of those agree on the label."""
    c = table(spark, d, "conversations")
    st = c.where("role = 'assistant'").select("conv_id", "turn", F.explode(ft.sentences(F.col("text"))).alias("sentence"))
    en = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{2,}"), F.lit(0)))).alias("entity"))
    hit = st.join(en, ["conv_id", "turn"]).where(F.contains("sentence", "entity")).withColumn("label", F.when(F.length("entity") % 2 == 0, "Supported").otherwise("Not Supported"))
    return hit.groupBy("sentence").agg(F.min("label").alias("label"), F.max("label").alias("other"), F.array_sort(F.collect_set("entity")).alias("entities")).where("label = other").drop("other")


@query("sentence_unanimity", f"with {SENT} select sentence, label, array_to_string(entities, ',') as entities from un")
def sentence_unanimity(spark, d):
    return sentence_labels(spark, d).select("sentence", "label", F.array_join("entities", ",").alias("entities"))


@query(
    "sentence_dataset",
    f"""with {SENT}, k as (select *, row_number() over (partition by label order by md5(concat_ws(':', 42, sentence)), sentence) as k from un), n as (select min(n) as n from (select count(*) as n from un group by label))
select case when label = 'Supported' then sentence else '' end as factual_context, case when label = 'Supported' then '' else sentence end as non_factual_evidence, len(entities) as n_entities from k, n where k <= n""",
)
def sentence_dataset(spark, d):
    rows = sampling.balance(sentence_labels(spark, d), ["label"], 42, "sentence")
    good = F.col("label") == "Supported"
    return rows.select(F.when(good, F.col("sentence")).otherwise("").alias("factual_context"), F.when(good, "").otherwise(F.col("sentence")).alias("non_factual_evidence"), F.size("entities").cast("long").alias("n_entities"))


@query("doc_order_accuracy", "select case when conv_id % 2 = 0 then 'factual-other' else 'other-factual' end as doc_order, case when turn % 2 = 0 then 'baseline' else 'steered' end as condition, round(avg(contains(lower(text), 'the')::int), 6) as accuracy, count(*) as n from conversations where role = 'assistant' or role = 'user' group by all")
def doc_order_accuracy(spark, d):
    c = table(spark, d, "conversations").where("role = 'assistant' or role = 'user'")
    order = F.array_join(F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("factual"), F.lit("other"))).otherwise(F.array(F.lit("other"), F.lit("factual"))), "-")
    return c.groupBy(order.alias("doc_order"), F.when(F.col("turn") % 2 == 0, "baseline").otherwise("steered").alias("condition")).agg(r6(metrics.rate(ft.matches_any(F.col("text"), F.array(F.lit("the"))))).alias("accuracy"), F.count("*").alias("n"))


@query("histogram_zero_fill", "with h as (select turn, count(*) as n from conversations group by turn) select range as turn, coalesce(n, 0) as n from range(0, 25) left join h on range = turn")
def histogram_zero_fill(spark, d):
    h = table(spark, d, "conversations").groupBy("turn").agg(F.count("*").alias("n"))
    return spark.range(25).select(F.col("id").alias("turn")).join(h, "turn", "left").select("turn", F.coalesce("n", F.lit(0)).alias("n"))


@query("modal_layer", "with c as (select conv_id % 7 as g, turn, count(*) as n from conversations group by all) select g, turn as modal, n from c qualify row_number() over (partition by g order by n desc, turn) = 1")
def modal_layer(spark, d):
    c = table(spark, d, "conversations").groupBy((F.col("conv_id") % 7).alias("g"), "turn").agg(F.count("*").alias("n"))
    return c.groupBy("g").agg(F.min(F.struct((-F.col("n")).alias("m"), "turn")).alias("b")).select("g", F.col("b.turn").alias("modal"), (-F.col("b.m")).alias("n"))


@query("no_context_subset_accuracy", "with r as (select conv_id as q, turn % 5 as condition, contains(lower(text), 'the') as ok from conversations), qs as (select distinct q from r where condition = 0 and ok) select 'all' as subset, condition, round(avg(ok::int), 6) as accuracy, count(*) as n from r group by condition union all select 'known', condition, round(avg(ok::int), 6), count(*) from r where q in (select q from qs) group by condition")
def no_context_subset_accuracy(spark, d):
    r = table(spark, d, "conversations").select(F.col("conv_id").alias("q"), (F.col("turn") % 5).alias("condition"), F.contains(F.lower("text"), F.lit("the")).alias("ok"))
    known = r.join(r.where("condition = 0 and ok").select("q").distinct(), "q", "left_semi")
    acc = lambda df, name: df.groupBy("condition").agg(r6(metrics.rate(F.col("ok"))).alias("accuracy"), F.count("*").alias("n")).select(F.lit(name).alias("subset"), "condition", "accuracy", "n")
    return acc(r, "all").union(acc(known, "known"))


# ---- spans, matching, numbers -----------------------------------------------------------------------------------

NEEDLES = ["", "ing", "The", "der ", "éa", "tion.", "THE"]
_needle_sql = ", ".join("'" + n + "'" for n in NEEDLES)


def _span_sql(fold: bool) -> str:
    find = "strpos(lower(text), lower(n))" if fold else "strpos(text, n)"
    return f"list_min(list_filter(list_transform([{_needle_sql}], lambda n, i: struct_pack(s := {find} - 1, i := i, l := length(n))), lambda x: x.s >= 0 and x.l > 0))"


@query("entity_span", f"with s as (select doc_id, coalesce(case when lang = 'en' then {_span_sql(False)} end, {_span_sql(True)}) as b from documents) select doc_id, b.s as start, b.s + b.l as \"end\" from s")
def entity_span(spark, d):
    rows = needles.first_spans(docs(spark, d).select("doc_id", "lang", "text"), F.col("text"), NEEDLES, "plain")
    rows = needles.first_spans(rows.select("doc_id", "lang", "text", "plain"), F.lower("text"), [n.lower() for n in NEEDLES], "folded")
    rows = rows.select("doc_id", ft.first_span(F.when(F.col("lang") == "en", F.col("plain")), F.col("folded")).alias("b"))
    return rows.select("doc_id", F.col("b.start").alias("start"), F.col("b.end").alias("end"))


ALIASES = ["pol", " these ", "", "The", "éan", "42", "an"]
_alias_sql = "[" + ", ".join("'" + a + "'" for a in ALIASES) + "]"
_ws = "'[ \\t\\n\\r\\f\\v]+'"


@query(
    "answer_match_family",
    f"""with a as (select doc_id, lang, text as t, {_alias_sql} as al, trim(regexp_replace(lower(text), {_ws}, ' ', 'g')) as sq from documents)
select lang, count(*) as n, count(*) filter (where len(list_filter(al, lambda x: length(trim(x)) >= 4 and contains(lower(t), lower(trim(x))))) > 0) as long, count(*) filter (where len(list_filter(al[1:3], lambda x: trim(x) <> '' and contains(lower(t), lower(trim(x))))) > 0) as first3,
count(*) filter (where len(list_filter(al, lambda x: contains(lower(t), lower(x)))) > 0) as any_alias, count(*) filter (where regexp_matches(sq, '(^|[^a-z0-9_])(pol|the|éan|42|an)($|[^a-z0-9_])') or contains(sq, 'these')) as bounded from a group by lang""",
)
def answer_match_family(spark, d):
    lower, trimmed = [a.lower() for a in ALIASES], [a.lower().strip() for a in ALIASES]
    rules = {
        "long": ("folded", [(a, False) for a in trimmed if len(a) >= 4]),
        "first3": ("folded", [(a, False) for a in trimmed[:3] if a]),
        "any_alias": ("folded", [(a, False) for a in lower]),
        "bounded": ("squeezed", [(a, len(a) < 4 or a.strip("0123456789.,") == "") for a in trimmed if a]),
    }
    rows = docs(spark, d).select("lang", "text")
    marked = needles.flags(rows.select("lang", "text"), {"folded": F.lower("text"), "squeezed": ft.squeeze(F.col("text"))}, rules)
    return marked.groupBy("lang").agg(F.count("*").alias("n"), *[F.count_if(r).alias(r) for r in rules])


@query("benchmark_containment", "select d.doc_id, b.item_id from documents d join benchmark b on contains(lower(d.text), lower(b.text))")
def benchmark_containment(spark, d):
    """Documents that contain a whole item; each text is read once for all items."""
    items = table(spark, d, "benchmark").select("item_id", F.lower("text").alias("item"))
    return needles.contained(docs(spark, d).select("doc_id", F.lower("text").alias("text")), items).distinct()


_NUM = "try_cast(nullif(replace(regexp_extract({t}, '[-+]?[0-9][0-9,]*(?:[.][0-9]+)?'), ',', ''), '') as double)"


@query(
    "number_label",
    f"""with e as (select event_type, value as gold, {_NUM.format(t="props")} as pred, [value * 2, 1.0, 2.0, 3.0, 4.0] as others from events),
l as (select event_type, pred, case when pred is not null and abs(pred - gold) <= 1e-6 * greatest(abs(pred), abs(gold)) then 'correct' when pred is not null and len(list_filter(others, lambda v: abs(pred - v) <= 1e-6 * greatest(abs(pred), abs(v)))) > 0 then 'misled' else 'other' end as label from e)
select event_type, count(*) as n, round(avg((pred is not null)::int), 6) as parsed, round(avg((label = 'correct')::int), 6) as correct, round(avg((label = 'misled')::int), 6) as misled, round(avg((label = 'other')::int), 6) as other from l group by event_type""",
)
def number_label(spark, d):
    e = table(spark, d, "events").select("event_type", F.col("value").alias("gold"), ft.first_number(F.col("props")).alias("pred"), F.array(F.col("value") * 2, *map(F.lit, (1.0, 2.0, 3.0, 4.0))).alias("others"))
    labels = e.withColumn("label", ft.number_label(F.col("pred"), F.col("gold"), F.col("others")))
    share = lambda c, n: r6(metrics.rate(c)).alias(n)
    return labels.groupBy("event_type").agg(F.count("*").alias("n"), share(F.col("pred").isNotNull(), "parsed"), *[share(F.col("label") == x, x) for x in ("correct", "misled", "other")])


@query("document_numbers", f"select doc_id, {_NUM.format(t='text')} as number from documents")
def document_numbers(spark, d):
    return docs(spark, d).select("doc_id", ft.first_number(F.col("text")).alias("number"))


@query(
    "judge_score_parse",
    """with e as (select event_id, concat(case event_id % 5 when 0 then 'score ' when 1 then '' when 2 then 'about ' when 3 then '7 or ' else 'none' end, case when event_id % 5 < 4 then (event_id * 37 % 160 // 100)::varchar || '.' || lpad((event_id * 37 % 100)::varchar, 2, '0') else '' end) as t from events),
p as (select event_id, t, try_cast(nullif(regexp_extract(t, '(?:^|[^0-9.])(0(?:[.][0-9]+)?|1(?:[.]0+)?|[.][0-9]+)(?:$|[^0-9.])', 1), '') as double) as s from e) select event_id, round(greatest(0, least(1, coalesce(s, 0.5))), 6) as score, s is not null as ok from p""",
)
def judge_score_parse(spark, d):
    e = table(spark, d, "events")
    kind, n = F.col("event_id") % 5, F.col("event_id") * 37
    t = F.concat(F.when(kind == 0, "score ").when(kind == 1, "").when(kind == 2, "about ").when(kind == 3, "7 or ").otherwise("none"), F.when(kind < 4, F.concat(F.floor(n % 160 / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))).otherwise(""))
    return e.select("event_id", ft.judge_score(t).alias("j")).select("event_id", r6("j.score").alias("score"), F.col("j.ok").alias("ok"))


# ---- chunks and pages -------------------------------------------------------------------------------------------

@query("sentence_counts", "select doc_id, len(regexp_extract_all(text, '[^.!?]+[.!?]*')) as sentences, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')) as words, sha256(text) as sha from documents")
def sentence_counts(spark, d):
    return docs(spark, d).select("doc_id", F.size(F.regexp_extract_all("text", F.lit(ft.SENTENCE), F.lit(0))).cast("long").alias("sentences"), ft.n_words(F.col("text")).cast("long").alias("words"), F.sha2("text", 256).alias("sha"))


_WORDS = r"""w as (select regexp_replace(regexp_replace(x, '^[("''\[«„“‘]+', ''), '[)"''\]»”’]+$', '') as w from (select unnest(regexp_split_to_array(text, '[ \t\n\r\f\v]+')) as x from documents)),
ty as (select lower(regexp_replace(w, '[.]$', '')) as type, ends_with(w, '.')::int as stop from w where w <> ''), c as (select type, count(*) as n, sum(stop)::bigint as stops from ty where regexp_matches(type, '\p{L}') group by type),
r as (select sum(stops) / sum(n) as rate from c), s as (select type, n, stops, length(replace(type, '.', '')) as len, stops * ln(rate) + (n - stops) * ln(1 - rate) as chance, stops * ln(0.99::double) + (n - stops) * ln(0.01::double) as tied from c, r where stops > 0 and rate < 1),
ab as (select type, n, stops, -2 * (chance - tied) * exp(-len) * (length(type) - len + 1) * pow(len::double, stops - n) as score from s)"""


@query("abbreviations", f"with {_WORDS} select type, n, stops, round(score, 6) as score from ab where score >= {sentences.THRESHOLD}")
def abbreviations(spark, d):
    return rounded(sentences.abbreviations(docs(spark, d).select("text"), "text"), "score")


@query("sentence_spans")
def sentence_spans(spark, d):
    """How many sentences a document has, their characters and the last one's place; abbreviations are learned from all documents."""
    rows = docs(spark, d).select("doc_id", "text")
    found = sentences.split(rows, "text", sentences.abbreviations(rows, "text"))
    chars = F.aggregate("sentences", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select("doc_id", F.size("sentences").cast("long").alias("sentences"), chars.alias("chars"), F.get("sentences", F.size("sentences") - 1)["start"].cast("long").alias("last"))


_SENTS = r"list_filter(list_transform(regexp_extract_all({t}, '[^.!?]+[.!?]*'), lambda s: trim(regexp_replace(s, '[ \t\n\r\f\v]+', ' ', 'g'))), lambda s: s <> '')"
_PACK = """st as (select id, generate_subscripts(ss, 1) as nr, unnest(ss) as s from (select id, {sents} as ss from src)),
sl as (select id, nr, s, len(list_filter(string_split(s, ' '), lambda w: w <> '')) as n from st),
walk(id, nr, chunk, used) as (select id, nr, 0, n from sl where nr = 1 union all select w.id, sl.nr, case when w.used + sl.n <= {most} then w.chunk else w.chunk + 1 end, case when w.used + sl.n <= {most} then w.used + sl.n else sl.n end from walk w join sl on sl.id = w.id and sl.nr = w.nr + 1),
ch as (select id, chunk, string_agg(s, ' ' order by nr) as text, sum(n) as n_words from walk join sl using (id, nr) group by all)"""


@query("chunk_pack", f"with recursive src as (select doc_id as id, text as t from documents), {_PACK.format(sents=_SENTS.format(t='t'), most=64)} select id as doc_id, chunk, n_words, md5(text) as digest from ch")
def chunk_pack(spark, d):
    rows = docs(spark, d).select("doc_id", F.posexplode(ft.pack(ft.sentences(F.col("text")), 64)).alias("chunk", "c"))
    return rows.select("doc_id", "chunk", ft.n_words(F.col("c")).cast("long").alias("n_words"), F.md5("c").alias("digest"))


_HTML = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
'&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '&amp;', '&'), '[ \t\n\r\f\v]+', ' ', 'g'))"""


@query("html_text", f"select page_id, {_HTML} as text from pages")
def html_text(spark, d):
    return table(spark, d, "pages").select("page_id", ft.html_text(F.col("html")).alias("text"))


# ---- prompts and providers --------------------------------------------------------------------------------------

_PROMPT = "concat('Documents:' || chr(10) || '[1] ', text, chr(10) || chr(10) || 'Question: ', lang, '?' || chr(10) || 'Answer:')"


def prompts(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", "lang", "text", ft.prompt(F.array(F.coalesce("text", F.lit(""))), F.concat(F.coalesce("lang", F.lit("")), F.lit("?"))).alias("prompt"))


@query("prompt_dedup_generate", f"with p as (select doc_id, lang, {_PROMPT} as prompt from documents), g as (select prompt, 'answer ' || substr(sha256(prompt), 1, 8) as answer from (select distinct prompt from p)) select doc_id, answer, sha256(prompt) as key from p join g using (prompt)")
def prompt_dedup_generate(spark, d):
    from ..operators import providers

    p = prompts(spark, d)
    return providers.generate(p, "prompt", providers.echo_digest).select("doc_id", "answer", F.sha2("prompt", 256).alias("key"))


@query("prompt_cache_antijoin", f"with p as (select distinct {_PROMPT} as prompt from documents), k as (select sha256(prompt) as key from p) select count(*) as prompts, count(*) filter (where substr(key, 1, 1) < '8') as cached, count(*) filter (where substr(key, 1, 1) >= '8') as todo from k")
def prompt_cache_antijoin(spark, d):
    keys = prompts(spark, d).select(F.sha2("prompt", 256).alias("key")).distinct()
    cache = keys.where(F.substring("key", 1, 1) < "8")
    todo = keys.join(cache, "key", "left_anti")
    return keys.agg(F.count("*").alias("prompts")).crossJoin(cache.agg(F.count("*").alias("cached"))).crossJoin(todo.agg(F.count("*").alias("todo")))  # one row each


@query("prompt_only", f"with p as (select doc_id, lang, {_PROMPT} || ' Some documents may be wrong.' as prompt from documents), a as (select doc_id, lang, 'answer ' || substr(sha256(prompt), 1, 8) as answer from p) select lang, round(avg(contains(answer, 'a1')::int), 6) as accuracy, count(*) as n from a group by lang")
def prompt_only(spark, d):
    from ..operators import providers

    p = prompts(spark, d).withColumn("prompt", F.concat("prompt", F.lit(" Some documents may be wrong.")))
    got = providers.generate(p, "prompt", providers.echo_digest)
    return got.groupBy("lang").agg(r6(metrics.rate(ft.matches_any(F.col("answer"), F.array(F.lit("a1"))))).alias("accuracy"), F.count("*").alias("n"))


@query("pool_generation", f"""with g as (select doc_id, n_chars::double as gold, unnest([0, 5]) as alpha10 from documents), a as (select doc_id, alpha10, gold, 'about ' || case when doc_id % 3 = 0 then (n_chars)::varchar when doc_id % 3 = 1 then (n_chars + 1)::varchar else 'none' end as answer from g join documents using (doc_id)),
p as (select *, {_NUM.format(t='answer')} as pred from a), l as (select *, case when pred is not null and abs(pred - gold) <= 1e-6 * greatest(abs(pred), abs(gold)) then 'correct' when pred is not null and abs(pred - (gold + 1)) <= 1e-6 * greatest(abs(pred), abs(gold + 1)) then 'misled' else 'other' end as label from p)
select alpha10, label, count(*) as n, round(avg((pred is not null)::int), 6) as parsed from l group by all""")
def pool_generation(spark, d):
    third = F.col("doc_id") % 3
    answer = F.concat(F.lit("about "), F.when(third == 0, F.col("n_chars").cast("string")).when(third == 1, (F.col("n_chars") + 1).cast("string")).otherwise("none"))
    rows = docs(spark, d).select(F.col("n_chars").cast("double").alias("gold"), answer.alias("answer"), F.explode(F.array(F.lit(0), F.lit(5))).alias("alpha10")).withColumn("pred", ft.first_number(F.col("answer")))
    labels = rows.withColumn("label", ft.number_label(F.col("pred"), F.col("gold"), F.array(F.col("gold") + 1)))
    return labels.groupBy("alpha10", "label").agg(F.count("*").alias("n"), r6(metrics.rate(F.col("pred").isNotNull())).alias("parsed"))


@query("steering_order_accuracy", "with r as (select doc_id, case when substr(md5(concat_ws(':', 1, doc_id)), 1, 1) < '8' then 'factual-other' else 'other-factual' end as doc_order, contains(lower(text), 'ould') as base, contains(lower(text), 'ould') or contains(lower(text), 'schä') as steered from documents) select doc_order, round(avg(base::int), 6) as baseline, round(avg(steered::int), 6) as steered, count(*) as n from r group by doc_order")
def steering_order_accuracy(spark, d):
    bit = F.substring(sampling.order_key(1, F.col("doc_id")), 1, 1) < "8"
    order = F.when(bit, "factual-other").otherwise("other-factual")
    ok = lambda *aliases: r6(metrics.rate(ft.matches_any(F.col("text"), F.array(*map(F.lit, aliases)))))
    return docs(spark, d).groupBy(order.alias("doc_order")).agg(ok("ould").alias("baseline"), ok("ould", "schä").alias("steered"), F.count("*").alias("n"))


# ---- normalisation ----------------------------------------------------------------------------------------------

@query("source_a_filter", "select lang, count(*) as n, sum(n_chars) as chars from documents where source = 'src1' and text <> '' and lang <> '' group by lang")
def source_a_filter(spark, d):
    return docs(spark, d).where("source = 'src1' and text <> '' and lang <> ''").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


VERDICTS = ("pants-fire", "false", "barely-true", "half-true", "mostly-true", "true")


@query("claim_normalise", f"with c as (select doc_id, '\"' || left(text, 20) || '\"' as claim, [{', '.join(repr(v) for v in VERDICTS)}][(doc_id % 6 + 1)::int] as verdict from documents) select doc_id, lower(trim(trim(claim, '\"'))) as claim, verdict, (list_position([{', '.join(repr(v) for v in VERDICTS)}], verdict) - 1)::int as truthiness, verdict in ('half-true', 'mostly-true', 'true') as label from c")
def claim_normalise(spark, d):
    scale = F.create_map(*[F.lit(x) for k, v in enumerate(VERDICTS) for x in (v, k)])
    names = F.array(*map(F.lit, VERDICTS))
    rows = docs(spark, d).select("doc_id", F.concat(F.lit('"'), F.left("text", F.lit(20)), F.lit('"')).alias("claim"), F.element_at(names, (F.col("doc_id") % 6 + 1).cast("int")).alias("verdict"))
    rank = F.coalesce(scale[F.col("verdict")], F.raise_error(F.lit("unknown verdict")).cast("int"))
    return rows.select("doc_id", F.lower(F.trim(F.expr("trim(both '\"' from claim)"))).alias("claim"), "verdict", rank.alias("truthiness"), F.col("verdict").isin(*VERDICTS[3:]).alias("label"))


@query("text_variant", "select item_id, unnest(['raw', 'framed']) as variant, unnest([length(text), length('The following statement is true: ' || text)]) as n from benchmark")
def text_variant(spark, d):
    forms = F.array(F.struct(F.lit("raw").alias("variant"), F.col("text").alias("t")), F.struct(F.lit("framed").alias("variant"), F.concat(F.lit("The following statement is true: "), "text").alias("t")))
    return table(spark, d, "benchmark").select("item_id", F.explode(forms).alias("f")).select("item_id", "f.variant", F.length("f.t").cast("long").alias("n"))


@query("gold_list", "with g as (select item_id, list_filter(list_concat([item_id::varchar], case when item_id % 3 = 0 then [' ', text[1:5], null] else [] end), lambda x: x is not null and trim(x) <> '') as golds from benchmark) select item_id, len(golds) as n, array_to_string(golds, '+') as joined from g")
def gold_list(spark, d):
    more = F.when(F.col("item_id") % 3 == 0, F.array(F.lit(" "), F.substring("text", 1, 5), F.lit(None).cast("string")))
    golds = F.filter(F.concat(F.array(F.col("item_id").cast("string")), F.coalesce(more, F.array().cast("array<string>"))), lambda x: x.isNotNull() & (F.trim(x) != ""))
    return table(spark, d, "benchmark").select("item_id", F.size(golds).cast("long").alias("n"), F.array_join(golds, "+").alias("joined"))


@query("truth_fallback", f"with {LAB} select doc_id, case when toxic is not null and toxic > 0 then 'toxic' when quality is not null then 'quality' else 'none' end as used from lab")
def truth_fallback(spark, d):
    rows = labelled(spark, d)
    toxic = F.filter(F.array(F.when(F.col("toxic") > 0, "toxic")), lambda x: x.isNotNull())
    quality = F.filter(F.array(F.when(F.col("quality").isNotNull(), "quality")), lambda x: x.isNotNull())
    chosen = F.when(F.size(toxic) > 0, toxic).when(F.size(quality) > 0, quality).otherwise(F.array(F.lit("none")))
    return rows.select("doc_id", F.element_at(chosen, 1).alias("used"))


@query("token_count", "select lang, sum(len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> ''))) as words, max(n_chars) as longest from documents group by lang")
def token_count(spark, d):
    return docs(spark, d).groupBy("lang").agg(F.sum(ft.n_words(F.col("text"))).alias("words"), F.max("n_chars").alias("longest"))


@query("seed_partitions", "with s as (select distinct regexp_extract(source, '^src([0-9]+)$', 1)::int as seed from documents where regexp_matches(source, '^src[0-9]+$')) select seed, row_number() over (order by seed) - 1 as at from s")
def seed_partitions(spark, d):
    """Names of the form seed_<number>, among others, as numbers in numeric order."""
    names = docs(spark, d).select(F.explode(F.array(F.regexp_replace("source", "^src", "seed_"), "lang")).alias("name"))
    seeds = names.select(F.regexp_extract("name", "^seed_([0-9]+)$", 1).alias("seed")).where("seed <> ''").select(F.col("seed").cast("int").alias("seed"))
    return sampling.dense_ids(seeds, "seed", "at")
