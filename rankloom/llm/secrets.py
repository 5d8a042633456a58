"""Secret scans: fixed patterns, and character Markov models for random strings; DataFrame functions only.

The base kinds are regular expressions, leftmost and not overlapping within a kind. Positions come from the texts between
the matches, so one pass of split() and one of regexp_extract_all() give every span, in code points. Sums and maxima along the matches run
in nested blocks, so that work and memory grow with the number of spans, not with its square.

The added kind, `markov`, looks at runs of 12 or more of `A-Za-z0-9+/_=-` that hold a digit and a letter, in what the base spans leave of a
text. Two first-order character models, one of random strings and one of ordinary identifiers, are counted from
labelled samples: values of base matches against identifiers (runs with a letter and some other character) outside of them, from a bounded
sample of the documents themselves, with strings made by rule beside them, as many corpora hold few of either. A run is a secret if its
log-likelihood ratio is above a fixed threshold per transition and a fixed margin.

Defined results: null text is the empty text, without spans; repeated rows stay repeated; a null id stays null; an empty
table gives an empty result; other columns are kept by redact(), whatever their names, and not looked at by scan(). Without labelled samples of
both kinds every ratio is 0 and nothing is added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
RUN = r"[A-Za-z0-9+/_=-]{12,}"
#: A whole run with a digit and a letter, told at its start, so that other words cost no more than their own length.
MIXED = rf"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z]){RUN}"
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "markov")

#: Characters that the models tell apart; any other is number 0.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Log-likelihood ratio per transition, and on top of it, above which a run is random; and what is added to every count.
THRESHOLD, MARGIN, SMOOTH = 0.35, 2.0, 0.5
#: Labelled samples of each kind that are made by rule, and documents of which samples are taken, about.
N_SAMPLES, N_DOCS = 4000, 20_000
#: Matches in a block.
BLOCK = 256
#: Words of which ordinary identifiers are made.
WORDS = (
    "account action active address admin agent alert amount archive array asset auth balance batch binary block branch buffer build button byte cache "
    "call cancel card catalog channel check client clone cloud cluster code column command commit compile config connect console content context control "
    "copy count create current cursor daily data date debug decode default delete deploy detail device dialog digest direct disk display document domain "
    "download driver edit element email enable encode engine entry error event example execute export factory fetch field file filter final folder font "
    "format frame function gateway global graph group handler hash header height history home host image import index input insert install instance "
    "internal invoice item join journal kernel label language layer layout level library limit line link list load local lock login logger manager map "
    "margin market master match memory merge message method metric mobile model module monitor month mount name network node notice number object offset "
    "option order output owner package page panel parent parse partition password path pattern payment pending period person phone plugin point policy "
    "port prefix price primary print process product profile project property protocol proxy public query queue random range reader record region release "
    "remote render report request reset resource response result return review role root route sample schedule schema scope screen script search section "
    "select sender server service session setting shadow share signal simple size socket sort source stack stage start state static status storage stream "
    "string style submit summary support switch symbol system table target task template test text theme thread ticket time title token tools total trace "
    "track transfer tree trigger type unique update upload user valid value vector version video view visit volume watch week widget width window worker "
    "world write year zone"
).split()


def _joined(parts: list[Column], seps: Column) -> Column:
    return F.concat_ws("", *[x for k, p in enumerate(parts) for x in ((seps, p) if k else (p,))])


def labelled_samples(spark: SparkSession, n: int = N_SAMPLES) -> DataFrame:
    """(text, random boolean): n random strings and n ordinary identifiers, made by rule and the same in every run."""
    ids = spark.range(n)
    sha = F.sha2(F.concat(F.lit("sample:"), F.col("id").cast("string")), 256)
    b64 = F.base64(F.unhex(sha))
    words = F.array(*map(F.lit, WORDS))
    pick = lambda k: F.element_at(words, (F.pmod(F.xxhash64(F.col("id"), F.lit(k)), F.lit(len(WORDS))) + 1).cast("int"))
    kind = F.pmod(F.col("id"), F.lit(6))
    size = (F.pmod(F.xxhash64("id"), F.lit(20)) + 20).cast("int")
    strings = (
        F.when(kind == 0, sha).when(kind == 1, F.upper(sha)).when(kind == 2, F.translate(b64, "+/=", "-_")).when(kind == 3, F.upper(F.regexp_replace(b64, "[^A-Za-z0-9]", ""))).when(kind == 4, F.lower(F.regexp_replace(b64, "[^A-Za-z0-9]", ""))).otherwise(b64)
    )
    year = (F.pmod(F.col("id"), F.lit(60)) + 1970).cast("string")
    small = F.pmod(F.xxhash64(F.lit("n"), "id"), F.lit(1000)).cast("string")
    p = [pick(k) for k in range(4)]
    capital = [F.initcap(x) for x in p]
    names = (
        F.when(kind == 0, F.concat(_joined(p, F.lit("_")), F.lit("_"), year)).when(kind == 1, F.concat(_joined(p, F.lit("-")), small)).when(kind == 2, F.concat(p[0], *capital[1:], small))
        .when(kind == 3, F.concat(F.upper(_joined(p, F.lit("_"))), F.lit("_"), small)).when(kind == 4, F.concat(_joined(p, F.lit("/")), F.lit("/"), year, F.lit("/"), small)).otherwise(F.concat(year, F.lit("-0"), F.substring(small, 1, 1), F.lit("-"), _joined(p, F.lit("-"))))
    )
    return ids.select(F.substring(strings, F.lit(1), size).alias("text"), F.lit(True).alias("random")).union(ids.select(names.alias("text"), F.lit(False).alias("random")))


def corpus_samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_docs: int = N_DOCS) -> DataFrame:
    """(text, random boolean) from about n_docs documents, chosen by a hash: the values of base matches, and the identifiers outside of them."""
    share = min(1.0, n_docs / max(1, docs.count()))
    picked = F.pmod(F.xxhash64(docs[id_col], docs[text_col]), F.lit(1 << 32)) < F.lit(share * (1 << 32))
    some = docs.where(picked).select(docs[text_col].alias("text")).where("text is not null")
    values = F.concat(F.filter(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= ASSIGN_LEAST), *[F.regexp_extract_all("text", F.lit(p), F.lit(0)) for p in (ACCESS, HEX)])
    rest = F.regexp_replace("text", f"{ACCESS}|{HEX}|{ASSIGN}", " ")  # the last one is not told by case
    names = F.filter(F.regexp_extract_all(rest, F.lit(RUN), F.lit(0)), lambda v: v.rlike("[A-Za-z]") & v.rlike("[^A-Za-z]"))
    return some.select(F.explode(values).alias("text"), F.lit(True).alias("random")).union(some.select(F.explode(names).alias("text"), F.lit(False).alias("random")))


def train_on(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[float]:
    """A model from samples of the documents and those made by rule."""
    return train(corpus_samples(docs, id_col, text_col).union(labelled_samples(docs.sparkSession)))


def _code(ch: Column) -> Column:
    return F.instr(F.lit(ALPHABET), ch)


def _transitions(text: Column) -> Column:
    """Numbers of the transitions between neighbouring characters."""
    n = len(ALPHABET) + 1
    codes = F.transform(F.split(text, ""), _code)
    return F.zip_with(F.slice(codes, F.lit(1), F.greatest(F.size(codes) - 1, F.lit(0))), F.slice(codes, F.lit(2), F.greatest(F.size(codes) - 1, F.lit(0))), lambda a, b: a * n + b)


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio, random against ordinary, of each transition; both models are counted by Spark from (text, random)."""
    n = len(ALPHABET) + 1
    counts = samples.where("text is not null and random is not null").select("random", F.explode(_transitions(F.col("text"))).alias("t")).groupBy("random", "t").count()
    seen = {(r["random"], r["t"]): r["count"] for r in counts.collect()}  # at most two rows for each of n * n transitions
    rows = {kind: [sum(seen.get((kind, a * n + b), 0) for b in range(n)) for a in range(n)] for kind in (True, False)}
    if not (any(rows[True]) and any(rows[False])):
        return [0.0] * (n * n)
    log = lambda kind, a, b: math.log((seen.get((kind, a * n + b), 0) + SMOOTH) / (rows[kind][a] + SMOOTH * n))
    return [log(True, a, b) - log(False, a, b) for a in range(n) for b in range(n)]


def ratio(text: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a text, random against ordinary; 0 below two characters."""
    table = F.array(*map(F.lit, model))
    return F.aggregate(_transitions(text), F.lit(0.0), lambda s, k: s + F.element_at(table, k + 1))


def is_random(text: Column, model: list[float]) -> Column:
    return ratio(text, model) > THRESHOLD * (F.length(text) - 1) + MARGIN


def _bound(value: Column, body) -> Column:
    """body(value), value being worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _blocks(a: Column) -> Column:
    """An array as an array of arrays of up to BLOCK elements; of one empty array if it has none."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(a) / BLOCK).cast("int") - 1, F.lit(0))), lambda i: F.slice(a, i * BLOCK + 1, F.lit(BLOCK)))


def running(values: Column, step, levels: int = 3) -> Column:
    """For each element of an array of int the step (sum, greatest) over 0 and the elements before it.

    Blocks of BLOCK elements are gone through each, and their totals in the same way a level above.
    """
    none = F.array().cast("array<int>")
    total = lambda a: F.aggregate(a, F.lit(0), step)
    along = lambda a, start: F.aggregate(a, F.struct(start.alias("at"), none.alias("seen")), lambda acc, x: F.struct(step(acc["at"], x).alias("at"), F.concat(acc["seen"], F.array(acc["at"])).alias("seen")), lambda acc: acc["seen"])
    if levels == 1:
        return along(values, F.lit(0))
    return _bound(values, lambda a: _bound(_blocks(a), lambda p: F.flatten(F.zip_with(p, running(F.transform(p, total), step, levels - 1), along))))


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _largest(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _spans(text: Column, pattern: str, kind: int, keep: int | None = None) -> Column:
    """Array of (start, kind, end, value) of the matches of a pattern; keep: the least length of the second group."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if keep else found
    part = lambda b, m: F.struct(F.length(b).alias("gap"), F.length(m).alias("n"), m.alias("m"))
    parts = F.zip_with(F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, part), value, lambda x, v: F.struct(x["gap"].alias("gap"), x["n"].alias("n"), x["m"].alias("m"), (F.length(v) >= keep if keep else F.lit(True)).alias("ok")))

    def placed(p: Column) -> Column:
        starts = running(F.transform(p, lambda x: x["gap"] + x["n"]), _sum)
        spans = F.zip_with(p, starts, lambda x, s: F.struct((s + x["gap"]).alias("start"), F.lit(kind).alias("kind"), (s + x["gap"] + x["n"]).alias("end"), F.when(x["ok"], x["m"]).alias("value")))
        return F.filter(spans, lambda s: s["value"].isNotNull())

    return F.when(text.rlike(pattern), _bound(parts, placed)).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>"))


def between(text: Column, found: Column) -> Column:
    """Array of (start, text, open): what lies before each of the sorted spans, and after the last; open: the span begins outside of those before it."""
    ends = lambda f: F.zip_with(f, running(F.transform(f, lambda x: x["end"]), _largest), lambda x, e: F.struct(e.alias("a"), F.greatest(x["start"], e).alias("b"), (x["start"] >= e).alias("open")))
    last = F.struct(F.coalesce(F.array_max(F.transform(found, lambda x: x["end"])), F.lit(0)).alias("a"), F.length(text).alias("b"), F.lit(True).alias("open"))
    cut = lambda whole, lo, x: F.struct(x["a"].alias("start"), F.substring(whole, x["a"] - lo + 1, x["b"] - x["a"]).alias("text"), x["open"].alias("open"))

    def pieces(block: Column) -> Column:
        lo, hi = F.element_at(block, 1)["a"], F.element_at(block, -1)["b"]
        return _bound(F.substring(text, lo + 1, hi - lo), lambda whole: F.transform(block, lambda x: cut(whole, F.element_at(block, 1)["a"], x)))

    return _bound(F.concat(_bound(found, ends), F.array(last)), lambda parts: F.flatten(F.transform(_blocks(parts), pieces)))


def spans(docs: DataFrame, text_col: str, model: list[float], base: str, added: str) -> DataFrame:
    """docs with two more columns, sorted arrays of (start, kind, end, value): the base spans and the added ones."""
    text = F.coalesce(docs[text_col], F.lit(""))
    found = docs.withColumn(base, F.array_sort(F.concat(_spans(text, ASSIGN, 0, ASSIGN_LEAST), _spans(text, ACCESS, 1), _spans(text, HEX, 2))))
    moved = lambda p: F.transform(_spans(p["text"], MIXED, 3), lambda x: F.struct((x["start"] + p["start"]).alias("start"), x["kind"].alias("kind"), (x["end"] + p["start"]).alias("end"), x["value"].alias("value")))
    runs = F.when(F.size(base) == 0, _spans(text, MIXED, 3)).otherwise(F.flatten(F.transform(between(text, F.col(base)), moved)))
    return found.withColumn(added, runs).withColumn(added, F.when(F.size(added) > 0, F.filter(added, lambda r: is_random(r["value"], model))).otherwise(F.col(added)))


def _told(found: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: list[float] | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans) for every row of docs; without a model it is trained on docs."""
    model = model if model is not None else train_on(docs, id_col, text_col)
    at = spans(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), "text", model, "base", "added")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return at.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.size("added").cast("long").alias("n_markov"),
        F.sha2(_told(F.col("base")), 256).alias("base_sha256"), _told(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


MARK = "[SECRET]"


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", model: list[float] | None = None) -> DataFrame:
    """docs with every span, overlapping ones together, replaced by MARK; the length column, if there is one, follows. A null text stays null."""
    model = model if model is not None else train_on(docs, id_col, text_col)
    base, added, clean = common.spare_names(docs, 3)
    text = F.col(text_col)
    at = spans(docs, text_col, model, base, added).withColumn(base, F.array_sort(F.concat(base, added)))
    hit = F.size(base) > 0
    marked = lambda p, i: F.concat(p["text"], F.when(p["open"] & (i < F.size(base)), F.lit(MARK)).otherwise(F.lit("")))
    at = at.withColumn(clean, F.when(hit, F.array_join(F.transform(between(text, F.col(base)), marked), "")).otherwise(text))
    out = [F.col(clean).alias(c) if c == text_col else F.when(hit, F.length(clean).cast(docs.schema[c].dataType)).otherwise(docs[c]).alias(c) if c == length_col else docs[c] for c in docs.columns]
    return at.select(out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))
