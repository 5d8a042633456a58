"""Queries with probes, providers and sequence matching; they have no SQL twin."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import alike
from ..functions import text as ft
from ..functions import vectors as fv
from ..operators import lexical, metrics, ordered, probes, providers, sampling, sparse, stats
from ..sources.scratch import cut
from .base import query, r6, rounded, table, values, vectors


@query("probe_direction")
def probe_direction(spark, d):
    w = [float(x) for x in probes.probe(vectors(spark, d), "vec", "fact")]  # one number a component
    return rounded(values(spark, list(enumerate(w)), "i int, v double"), "v")


@query("probe_mixture")
def probe_mixture(spark, d):
    """Norms of the probes of all seven unions of three datasets, fitted in the same passes."""
    v = vectors(spark, d).withColumn("dataset", F.col("label") % 3)
    combos = [c for n in (1, 2, 3) for c in itertools.combinations(range(3), n)]
    w = probes.fit_all(v, "vec", "fact", "dataset", [set(c) for c in combos])
    out = [("+".join(map(str, c)), float(np.linalg.norm(x))) for c, x in zip(combos, w)]
    return rounded(values(spark, out, "combo string, norm double"), "norm")


@query("probe_auroc")
def probe_auroc(spark, d):
    return rounded(stats.auroc(probes.out_of_fold(vectors(spark, d), "vec", "fact", "vec_id"), [], "score", "fact"), "auroc")


@query("lexical_floor")
def lexical_floor(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", "text", F.length("text").cast("double").alias("len"), F.col("quality").cast("double").alias("label"))
    words = lexical.floor(rows, "doc_id").select(F.lit("words").alias("features"), r6("auroc").alias("auroc"))
    return words.union(probes.floor(rows, probes.length_model(), "doc_id").select(F.lit("length"), r6("auroc")))


def _identical(batches):
    for b in batches:
        out = [alike.identical_share(x.as_py(), y.as_py()) for x, y in zip(b.column(1), b.column(2))]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], ["doc_id", "identical"])


@query("chunk_identity")
def chunk_identity(spark, d):
    """Share of chunks that two versions of a text have in common, in order; the second version lacks its first sentence on odd ids.
    Every document has a row, whatever its length; a null text is the empty text."""
    s = ft.sentences(F.coalesce("text", F.lit("")))
    rows = table(spark, d, "documents").select("doc_id", ft.pack(s, 32).alias("a"), ft.pack(F.when(F.col("doc_id") % 2 == 1, F.slice(s, F.lit(2), F.greatest(F.size(s), F.lit(1)))).otherwise(s), 32).alias("b"))
    return rounded(rows.mapInArrow(_identical, "doc_id long, identical double"), "identical")


@query("chunk_identity_summary")
def chunk_identity_summary(spark, d):
    x = chunk_identity(spark, d).withColumn("side", F.col("doc_id") % 2)
    means = x.groupBy("side").agg(r6(F.avg("identical")).alias("mean"), r6(metrics.rate(F.col("identical") > 0.5)).alias("share_over_half"))
    return ordered.matched(means, rounded(ordered.quantiles(x, ["side"], "identical", {"median": 0.5, "p10": 0.1, "p25": 0.25}), "median", "p10", "p25"), ["side"], "left")


@query("provider_embed")
def provider_embed(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    made = providers.per_text(docs, "text", providers.hashed_embedding, "vec", "array<float>")
    return providers.with_result(docs, "text", made).select("doc_id", F.size("vec").alias("width"), F.round(fv.norm(F.col("vec")), 4).alias("norm"))


@query("provider_hidden_states")
def provider_hidden_states(spark, d):
    """One row in, a row for each layer out; last word only. A null text has one row, without a layer."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    made = providers.per_text(docs, "text", providers.hidden_states, "layers", "array<array<float>>")
    return providers.with_result(docs, "text", made).select("doc_id", F.posexplode_outer("layers").alias("layer", "vec")).select("doc_id", "layer", F.size("vec").alias("width"), F.round(fv.norm(F.col("vec")), 4).alias("norm"))


@query("provider_judge")
def provider_judge(spark, d):
    docs = table(spark, d, "documents").select("doc_id", ft.judge_prompt(F.coalesce("text", F.lit(""))).alias("prompt"))
    cache = docs.where("doc_id % 2 = 0").select("prompt").distinct().select("prompt", F.lit("0.25").alias("raw"))
    made = providers.per_text(docs, "prompt", providers.judge, "raw", "string", cache)
    return providers.with_result(docs, "prompt", made).select("doc_id", "raw", ft.judge_score(F.col("raw")).alias("j")).select("doc_id", "raw", r6("j.score").alias("score"), F.col("j.ok").alias("ok"))


@query("ab_choice_states")
def ab_choice_states(spark, d):
    """Hidden states of A/B prompts; half of the documents, in hash order, have the factual text as A."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", F.concat_ws(":", sampling.order_key(9, F.col("doc_id")), F.col("doc_id").cast("string")).alias("h"))
    ids = sampling.dense_ids(docs, "h", "k")
    last = ids.crossJoin(F.broadcast(ids.agg(F.count("*").alias("n")))).agg(F.max(F.when(F.col("k") < F.floor(F.col("n") / 2), F.col("h"))).alias("last"))  # one row each
    sides = docs.crossJoin(F.broadcast(last)).withColumn("side", F.when(F.col("h") <= F.col("last"), "A").otherwise("B"))
    asked = sides.select("doc_id", "side", ft.prompt(F.when(F.col("side") == "A", F.array("text", "lang")).otherwise(F.array("lang", "text")), F.lit("A or B?")).alias("prompt"))
    made = providers.per_text(asked, "prompt", providers.hidden_states, "layers", "array<array<float>>")
    return providers.with_result(asked, "prompt", made).select("doc_id", "side", F.size("layers").alias("layers"))


#: Features of the stand-in for an encoder.
FEATURES = 128


@query("sparse_feature_direction")
def sparse_feature_direction(spark, d):
    """A direction as the weighted sum of the feature rows that fire most unevenly; the encoder is a hashed random basis."""
    numbers = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: fv.hashed_normal(F.col("f") + 1000, i))
    encoder = cut(spark.range(FEATURES).select(F.col("id").alias("f")).select("f", numbers.alias("w"), F.lit(-1.0).alias("b")), "encoder")
    fires = sparse.firing(vectors(spark, d), encoder, "vec_id", "vec", "fact")
    sep = fires.select("f", (F.col("on") - F.col("off")).alias("sep")).orderBy(F.desc(F.round("sep", 9)), "f").limit(10)
    return rounded(sparse.direction(encoder, sep), "v")


@query("sparse_codes")
def sparse_codes(spark, d):
    """How many features of the encoder each vector fires, and their sum."""
    numbers = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: fv.hashed_normal(F.col("f") + 1000, i))
    encoder = cut(spark.range(FEATURES).select(F.col("id").alias("f")).select("f", numbers.alias("w"), F.lit(-1.0).alias("b")), "encoder")
    rows = sparse.codes(vectors(spark, d), encoder, "vec_id", "vec")
    return rows.select("vec_id", F.size("at").alias("features"), F.round(F.aggregate("a", F.lit(0.0), lambda s, x: s + x), 3).alias("total"))
