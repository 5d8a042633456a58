"""The first m documents of each query by the summed weights of the terms in common, from an inverted index with pruning.

The index has postings (term, block, document) for the terms that some query asks for; a block is a run of documents. Terms of a query are ordered by their
frequency. The rarest give a first set of documents, whose m-th best score is a bound that the answer can't fall below. The most frequent terms whose
weights together stay under the bound can't lift a document over it alone, so a document needs one of the others; blocks, then documents, whose others
and all of the frequent ones together stay under the bound are skipped. Of the rest, the documents with most of the rarer terms are scored to raise the bound, and what is
still not under it is scored. Weights are positive whole numbers, so scores are exact, and the result is that of scoring all pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import cut

#: Documents are looked at for the first bound until their postings reach so many times m.
SEEDS = 8
#: Of the documents that the first bound leaves, so many times m are scored to raise it.
LIKELY = 4


@dataclass
class Shortlist:
    """top: (q, key, score, pos) of every query; scored: (q, key) of the pairs whose score was worked out; postings: the index."""

    top: DataFrame
    scored: DataFrame
    postings: DataFrame


def index(docs: DataFrame, key: list[str], block: Column, terms: Column, asked: DataFrame) -> DataFrame:
    """(term, block, key) for the distinct terms of the documents that a query asks for."""
    each = docs.select(*key, block.alias("block"), F.explode(F.array_distinct(terms)).alias("term"))
    return cut(each.join(asked.select("term").distinct(), "term").select("term", "block", *key), "postings")


def _best(scores: DataFrame, key: list[str], m: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), *key)
    return scores.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= m)


def _scores(pairs: DataFrame, postings: DataFrame, asked: DataFrame, key: list[str]) -> DataFrame:
    """(q, key, score) of distinct pairs (q, key)."""
    return pairs.join(postings.drop("block"), key).join(asked, ["q", "term"]).groupBy("q", *key).agg(F.sum("weight").alias("score"))


def shortlist(docs: DataFrame, key: list[str], block: Column, terms: Column, queries: DataFrame, m: int) -> Shortlist:
    """docs: rows with a unique key; terms: an array column; queries: (q, term, weight), terms of a query distinct, weights positive whole numbers.

    Equal scores go by key. A query that fewer than m documents share a term with gets documents of score 0, smallest key first; so does one without
    any term, which must be given with a null term. Null terms are in no document.
    """
    asked = cut(queries.where("term is not null and weight > 0").select("q", "term", F.col("weight").cast("long").alias("weight")), "asked")
    postings = index(docs, key, block, terms, asked)
    frequency = postings.groupBy("term").agg(F.count("*").alias("df"))
    rarest = Window.partitionBy("q").orderBy("df", "term")  # the terms of one query
    known = asked.join(frequency, "term").withColumn("before", F.coalesce(F.sum("df").over(rarest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    known = cut(known.withColumn("rest", F.sum("weight").over(Window.partitionBy("q").orderBy(F.desc("df"), F.desc("term")))), "terms")  # weights of the terms at least as frequent

    first = known.where(F.col("before") < SEEDS * m).select("q", "term").join(postings, "term").select("q", *key).distinct()
    first = cut(_scores(first, postings, asked, key), "first")
    bound = _best(first, key, m).groupBy("q").agg(F.min("score").alias("bound"), F.count("*").alias("n")).where(F.col("n") == m).select("q", "bound")
    # a query without a bound keeps all documents with any of its terms
    with_bound = known.join(bound, "q", "left").withColumn("bound", F.coalesce("bound", F.lit(1)))
    plain = with_bound.where("rest < bound").groupBy("q").agg(F.sum("weight").alias("plain"))
    needed = with_bound.where("rest >= bound").join(plain, "q", "left").select("q", "term", "weight", "bound", F.coalesce("plain", F.lit(0)).alias("plain"))
    needed = cut(needed, "needed")

    partial = [F.sum("weight").alias("part"), F.first("plain").alias("plain"), F.first("bound").alias("bound")]
    enough = F.col("part") + F.col("plain") >= F.col("bound")
    in_blocks = needed.join(postings.select("term", "block").distinct(), "term").groupBy("q", "block").agg(*partial).where(enough).select("q", "block")
    rows = needed.join(postings, "term").join(in_blocks, ["q", "block"], "left_semi")
    left = rows.groupBy("q", *key).agg(*partial).where(enough).join(first.select("q", *key), ["q", *key], "left_anti")
    left = cut(left.select("q", *key, "part", "plain"), "left")
    # those with the most of the rarer terms raise the bound for the rest
    order = Window.partitionBy("q").orderBy(F.desc("part"), *key)
    likely = left.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= LIKELY * m)
    first = cut(_scores(likely.select("q", *key), postings, asked, key).unionByName(first), "likely")
    higher = _best(first, key, m).groupBy("q").agg(F.min("score").alias("bound"), F.count("*").alias("n")).where(F.col("n") == m).select("q", "bound")
    rest = left.join(higher, "q", "left").where(F.col("part") + F.col("plain") >= F.coalesce("bound", F.lit(0)))
    rest = rest.select("q", *key).join(first.select("q", *key), ["q", *key], "left_anti")
    scores = cut(_scores(rest, postings, asked, key).unionByName(first), "scores")

    # documents of score 0, for queries with too few others
    short = queries.select("q").distinct().join(scores.groupBy("q").agg(F.count("*").alias("n")), "q", "left").where(F.coalesce("n", F.lit(0)) < m).select("q")
    least = docs.select(*key).orderBy(*key).limit(2 * m)
    spare = short.crossJoin(F.broadcast(least)).join(scores.select("q", *key), ["q", *key], "left_anti").withColumn("score", F.lit(0).cast("long"))  # 2m documents
    return Shortlist(_best(scores.unionByName(spare), key, m), scores.select("q", *key), postings)
