"""Queries that write and read back: files, trees, stores, appends."""

from __future__ import annotations

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as ft
from ..sources import offsets, scratch, store
from ..streaming import incremental
from .base import query, r6, rounded, table, vectors


@query("parquet_scan", "select lang, count(*) as n, sum(n_chars) as chars from documents where n_chars > 100 group by lang")
def parquet_scan(spark, d):
    return table(spark, d, "documents").where("n_chars > 100").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("jsonl_roundtrip", "select doc_id % 10 as part, count(*) as n, count(distinct text) as questions, sum(case when doc_id % 3 = 0 then 0 else 2 end) as answers, md5(max(text)) as last from documents group by 1")
def jsonl_roundtrip(spark, d):
    answers = F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("lang", "source"))
    rows = table(spark, d, "documents").select(F.col("text").alias("question"), F.lit("").alias("factual_context"), answers.alias("factual_answer"), "text", F.lit(None).cast("array<string>").alias("ground_truth"), F.col("doc_id").cast("string").alias("original_dataset_id"))
    path = scratch.new_path(spark, "jsonl")
    store.write_jsonl(rows, path)
    back = store.read_jsonl(spark, path, store.SAMPLE)
    return back.groupBy((F.col("original_dataset_id").cast("long") % 10).alias("part")).agg(F.count("*").alias("n"), F.count_distinct("question").alias("questions"), F.sum(F.size("factual_answer")).alias("answers"), F.md5(F.max("question")).alias("last"))


@query("csv_roundtrip", "select doc_id, md5(text || '\"x\",' || chr(10)) as digest, case when doc_id % 4 = 0 then null else lang end as lang from documents")
def csv_roundtrip(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.concat("text", F.lit('"x",\n')).alias("text"), F.when(F.col("doc_id") % 4 == 0, None).otherwise(F.col("lang")).alias("lang"))
    path = scratch.new_path(spark, "csv")
    store.write_csv(rows, path)
    return store.read_csv(spark, path, "doc_id string, text string, lang string").select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("digest"), "lang")


@query("csv_formatted", "select event_type, case when event_type = 'click' then null else printf('%.2f', round(avg(value), 2)) end as mean, printf('%.4f', round(max(value), 4)) as largest from events group by event_type")
def csv_formatted(spark, d):
    cells = table(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("mean"), F.max("value").alias("largest")).withColumn("mean", F.when(F.col("event_type") != "click", F.col("mean")))
    path = scratch.new_path(spark, "cells")
    store.write_table_csv(cells, path, {"mean": 2, "largest": 4})
    return store.read_csv(spark, path, "event_type string, mean string, largest string")


@query("json_document", "select event_type, round(avg(value), 6) as mean, count(*) as n from events group by event_type")
def json_document(spark, d):
    cells = table(spark, d, "events").groupBy("event_type").agg(r6(F.avg("value")).alias("mean"), F.count("*").alias("n"))
    one = cells.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("event_type", F.struct("mean", "n")))).alias("by"))).alias("j"))
    back = one.select(F.from_json("j", "by map<string, struct<mean: double, n: long>>").alias("s"))
    return back.select(F.explode("s.by").alias("event_type", "v")).select("event_type", "v.mean", "v.n")


@query("json_functions", "select event_id, event_type || ';' || (user_id % 3) as key, case when event_id % 2 = 0 then event_type else 'none' end as used from events")
def json_functions(spark, d):
    e = table(spark, d, "events")
    m = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("1"), F.col("event_type")))
    keyed = e.withColumns({"s": F.struct("event_type", (F.col("user_id") % 3).alias("u")), "m": F.from_json(F.to_json(m), "map<string,string>")})
    used = F.coalesce(F.element_at(F.map_from_entries(F.transform(F.map_entries("m"), lambda x: F.struct(x["key"].cast("int"), x["value"]))), 1), F.lit("none"))
    return keyed.select("event_id", F.concat_ws(";", F.col("s.event_type"), F.col("s.u").cast("string")).alias("key"), used.alias("used"))


def records(spark: SparkSession, d: str):
    """Stand-in result records over a small tree, from the events."""
    e = table(spark, d, "events")
    return e.select("event_id", (F.col("value") > 50).alias("hit"), F.lit("m0").alias("model"), (F.col("user_id") % 2).cast("string").alias("eval"), F.lit("a").alias("direction"), F.lit("raw").alias("normalize"), F.when(F.col("event_id") % 2 == 0, 7).otherwise(42).alias("seed"), F.lit("mean").alias("procedure"), (F.col("event_id") % 3).cast("int").alias("layer"), F.lit("last_pos").alias("position"))


@query("hive_tree_discovery", "select case when event_id % 2 = 0 then 7 else 42 end as seed, (event_id % 3)::int as layer, count(*) as n, round(avg((value > 50)::int), 6) as rate from events where event_id % 3 <> 1 group by all")
def hive_tree_discovery(spark, d):
    path = scratch.new_path(spark, "tree")
    store.write_tree(records(spark, d), path, ["seed", "layer"])
    back = spark.read.parquet(path).where("layer <> 1")  # pruned by partition
    return back.groupBy("seed", "layer").agg(F.count("*").alias("n"), r6(F.avg(F.col("hit").cast("double"))).alias("rate"))


@query("legacy_tree_migration", "select (user_id % 2)::varchar as eval, case when event_id % 2 = 0 then 7 else 42 end as seed, (event_id % 3)::int as layer, 'last_pos' as position, count(*) as n from events group by all")
def legacy_tree_migration(spark, d):
    path, moved = scratch.new_path(spark, "legacy"), scratch.new_path(spark, "moved")
    rows = records(spark, d)
    named = rows.withColumn("at", F.concat_ws("/", "model", "eval", "direction", "normalize", F.concat(F.lit("seed_"), "seed"), "procedure", F.concat(F.lit("layer_"), "layer"), "position"))
    # directories without names: one small job per directory, of which there are a fixed dozen
    for at in [r["at"] for r in named.select("at").distinct().collect()]:
        store.write_jsonl(named.where(F.col("at") == at).select("event_id", "hit"), f"{path}/{at}")
    store.write_tree(store.read_tree(spark, path, "event_id long, hit boolean"), moved, list(store.TREE))
    return spark.read.parquet(moved).groupBy(F.col("eval").cast("string").alias("eval"), "seed", "layer", "position").agg(F.count("*").alias("n"))


@query("best_partition_copy", "with r as (select (event_id % 3)::int as layer, avg((value > 50)::int) as rate from events group by 1), b as (select layer from r order by rate desc, layer limit 1) select (event_id % 3)::int as layer, case when event_id % 2 = 0 then 7 else 42 end as seed, count(*) as n from events where event_id % 3 in (select layer from b) group by all")
def best_partition_copy(spark, d):
    rows = records(spark, d)
    best = rows.groupBy("layer").agg(F.avg(F.col("hit").cast("double")).alias("r")).orderBy(F.desc("r"), "layer").limit(1).select("layer")
    wanted = rows.select("layer", "seed").distinct().join(best, "layer", "left_semi")
    path = scratch.new_path(spark, "best")
    store.copy_partitions(rows, wanted, ["layer", "seed"], path)
    return spark.read.parquet(path).groupBy("layer", "seed").agg(F.count("*").alias("n"))


@query("partition_listing", "select unnest([7, 42]) as seed")
def partition_listing(spark, d):
    path = scratch.new_path(spark, "list")
    store.write_tree(records(spark, d), path, ["seed", "layer"])
    return store.partitions(spark.read.parquet(path), "seed")


@query("layers_in_every_seed", "select unnest([0, 2]) as layer")
def layers_in_every_seed(spark, d):
    return store.in_every(records(spark, d).where("not (seed = 42 and layer = 1)"), "layer", "eval", "seed")


@query("incremental_append", "select event_type, count(*) as n from events group by event_type")
def incremental_append(spark, d):
    e, path = table(spark, d, "events"), scratch.new_path(spark, "append")
    for part in ("event_id % 4 = 0", "event_id % 4 < 2", "event_id % 4 < 2", "event_id % 4 in (1, 2)", "event_id % 4 > 0"):  # overlapping and repeated runs
        incremental.append_new(e.where(part), path, ["event_id"])
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"))


@query("stream_append", "select event_type, count(*) as n from events group by event_type")
def stream_append(spark, d):
    e = table(spark, d, "events")
    inbox, path, check = (scratch.new_path(spark, n) for n in ("inbox", "stream", "check"))
    for part in ("event_id % 2 = 0", "event_id % 3 = 0", "event_id % 2 = 1"):  # arrivals that overlap
        e.where(part).write.mode("append").parquet(inbox)
        incremental.append_stream(spark.readStream.schema(e.schema).parquet(inbox), path, ["event_id"], check).awaitTermination()
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"))


@query("vector_table_roundtrip", "select vec_id, len(embedding)::int as width, round(list_sum(list_transform(embedding::double[], lambda x: x * x)), 4) as square from embeddings")
def vector_table_roundtrip(spark, d):
    path = scratch.new_path(spark, "vectors")
    table(spark, d, "embeddings").select("vec_id", "embedding").write.parquet(path)
    back = spark.read.parquet(path)
    return back.select("vec_id", F.size("embedding").alias("width"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 4).alias("square"))


@query("direction_store", "select label % 3 as dataset, label as layer, avg(embedding[1]::double)::float::double as first, count(*) as n_pos from embeddings group by label")
def direction_store(spark, d):
    from ..functions import vectors as fv

    v = vectors(spark, d)
    means = fv.collect(fv.explode(v, "vec", "label").groupBy("label", "i").agg(F.avg("x").alias("m")), ["label"], "m", "direction")
    rows = means.join(v.groupBy("label").agg(F.count("*").alias("n_pos")), "label").select((F.col("label") % 3).alias("dataset"), F.lit(7).alias("seed"), F.col("label").alias("layer"), F.lit("last_pos").alias("position"), F.col("direction").cast("array<float>").alias("direction"), F.create_map(F.lit("n_pos"), F.col("n_pos").cast("string")).alias("meta"))
    path = scratch.new_path(spark, "directions")
    store.save_directions(rows, path)
    back = store.load_directions(spark, path, 64)
    return back.select("dataset", "layer", F.element_at("direction", 1).cast("double").alias("first"), F.element_at("meta", "n_pos").cast("long").alias("n_pos"))


@query("probe_import", "select 'qa' as dataset, (vec_id % 5)::int as seed, (vec_id // 5)::int as layer, 'last_pos' as position, len(embedding)::int as width from embeddings where vec_id % 7 > 0")
def probe_import(spark, d):
    v = table(spark, d, "embeddings")
    name = F.when(F.col("vec_id") % 7 > 0, F.concat(F.lit("qa_seed"), F.col("vec_id") % 5, F.lit("_layer"), F.floor(F.col("vec_id") / 5), F.lit("_last_pos"))).otherwise("notes.txt")
    return store.import_coefficients(v.select(name.alias("name"), F.col("embedding").alias("coef"))).select("dataset", "seed", "layer", "position", F.size("direction").alias("width"))


@query("corpus_version", "select unnest(['same', 'other']) as version, unnest([true, false]) as matches")
def corpus_version(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    path = scratch.new_path(spark, "version")
    docs.hint("rebalance").write.parquet(path)  # dealt out anew, in parts of bounded size
    kept = store.fingerprint(spark.read.parquet(path), "doc_id", "text").select(F.col("digest").alias("kept"))
    other = store.fingerprint(docs.where("doc_id > 0"), "doc_id", "text").select(F.lit("other").alias("version"), "digest")
    both = store.fingerprint(docs, "doc_id", "text").select(F.lit("same").alias("version"), "digest").union(other)
    return both.crossJoin(kept).select("version", (F.col("digest") == F.col("kept")).alias("matches"))  # two rows


@query("record_sample", "select page_id, url from pages order by md5(concat_ws(':', 42, page_id)), page_id limit 20")
def record_sample(spark, d):
    """Twenty records, read by seek from JSON-lines shards of all pages."""
    path = scratch.new_path(spark, "shards")
    store.write_jsonl(table(spark, d, "pages").select("page_id", "url", "html"), path)
    picked = offsets.sample(offsets.build(spark, path, "page_id"), 20, 42)
    return offsets.fetch(picked, "page_id long, url string, html string").select("record.page_id", "record.url")


@query("web_record_explode", "select conv_id, count(*) as results, sum(length(text)) as chars from conversations where turn < 3 group by conv_id")
def web_record_explode(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("page_result")))).alias("search_results"))
    path = scratch.new_path(spark, "web")
    store.write_jsonl(c, path)
    back = store.read_jsonl(spark, path, "conv_id long, search_results array<struct<turn:long,page_result:string>>")
    pages = back.select("conv_id", F.explode(F.slice("search_results", 1, 3)).alias("r")).where("r.turn < 3")
    return pages.groupBy("conv_id").agg(F.count("*").alias("results"), F.sum(F.length("r.page_result")).alias("chars"))


@query("literal_lists", "select item_id, 2 as n, 'a b' as first from benchmark")
def literal_lists(spark, d):
    lists = F.when(F.col("item_id") % 2 == 0, "['a b', 'c']").otherwise("[\"a b\", 'it is']")
    return table(spark, d, "benchmark").select("item_id", ft.quoted_list(lists).alias("l")).select("item_id", F.size("l").alias("n"), F.element_at("l", 1).alias("first"))


@query("place_in_series", "select event_type, min(event_id) as first, count(*) as n from events group by event_type")
def place_in_series(spark, d):
    e = table(spark, d, "events").select("event_type", "event_id")
    w = Window.partitionBy("event_type").orderBy("event_id")
    return rounded(e.withColumns({"k": F.row_number().over(w)}).groupBy("event_type").agg(F.min(F.when(F.col("k") == 1, F.col("event_id"))).alias("first"), F.max("k").cast("long").alias("n")))
