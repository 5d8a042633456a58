"""Column functions over texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = "[-+]?[0-9][0-9,]*(?:[.][0-9]+)?"
SENTENCE = "[^.!?]+[.!?]*"
#: A judge's answer: a number from 0 to 1 that touches no other digit or point.
SCORE = "(?:^|[^0-9.])(0(?:[.][0-9]+)?|1(?:[.]0+)?|[.][0-9]+)(?:$|[^0-9.])"


def squeeze(t: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(t), r"\s+", " "))


def escaped(t: Column) -> Column:
    return F.regexp_replace(t, r"([^A-Za-z0-9 ])", r"\\$1")


def find(t: Column, needle: Column, fold: bool = False, bounded: bool = False) -> Column:
    """0-based place of the first occurrence, -1 if there is none."""
    if bounded:
        return F.regexp_instr(t, F.concat(F.lit("(?i)" if fold else ""), F.lit(r"\b"), escaped(needle), F.lit(r"\b"))) - 1
    return F.instr(F.lower(t), F.lower(needle)) - 1 if fold else F.instr(t, needle) - 1


def earliest_span(t: Column, needles: Column, fold: bool = False, bounded: bool = False) -> Column:
    """struct(start, end) of the earliest occurrence of any needle, 0-based and end-exclusive; empty needles don't count, the first wins a tie."""
    at = F.transform(needles, lambda n, i: F.struct(find(t, n, fold, bounded).alias("start"), i.alias("k"), F.length(n).alias("size")))
    best = F.array_min(F.filter(at, lambda s: (s["start"] >= 0) & (s["size"] > 0)))
    return F.when(best.isNotNull(), F.struct(best["start"].alias("start"), (best["start"] + best["size"]).alias("end")))


def first_span(*spans: Column) -> Column:
    return F.coalesce(*spans)


def let(value: Column, body) -> Column:
    """body(value), where value is evaluated once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def matches_long(answer: Column, aliases: Column) -> Column:
    """Any alias of at least 4 characters, trimmed, is contained; case doesn't count."""
    return let(F.lower(answer), lambda t: F.exists(aliases, lambda a: (F.length(F.trim(a)) >= 4) & F.contains(t, F.lower(F.trim(a)))))


def matches_first3(answer: Column, aliases: Column) -> Column:
    """Any of the first three aliases that isn't blank is contained; case doesn't count."""
    return let(F.lower(answer), lambda t: F.exists(F.slice(aliases, 1, 3), lambda a: (F.trim(a) != "") & F.contains(t, F.lower(F.trim(a)))))


def matches_any(answer: Column, aliases: Column) -> Column:
    """Any alias is contained, an empty one always; case doesn't count."""
    return let(F.lower(answer), lambda t: F.exists(aliases, lambda a: F.contains(t, F.lower(a))))


def matches_bounded(answer: Column, golds: Column) -> Column:
    """Short or numeric golds as whole words, others as parts; case and white space squeezed."""

    def one(text, g):
        short = (F.length(g) < 4) | g.rlike("^[0-9.,]+$")
        # the pattern is tried only where the gold is contained at all
        whole = F.contains(text, g) & F.regexp_like(text, F.concat(F.lit("(^|[^a-z0-9_])"), escaped(g), F.lit("($|[^a-z0-9_])")))
        return (g != "") & F.when(short, whole).otherwise(F.contains(text, g))

    return let(squeeze(answer), lambda t: F.exists(F.transform(golds, squeeze), lambda g: one(t, g)))


def first_number(t: Column) -> Column:
    return F.nullif(F.replace(F.regexp_extract(t, NUMBER, 0), F.lit(","), F.lit("")), F.lit("")).try_cast("double")


def number_label(pred: Column, gold: Column, others: Column, rel: float = 1e-6) -> Column:
    near = lambda a, b: F.abs(a - b) <= rel * F.greatest(F.abs(a), F.abs(b))
    return F.when(pred.isNotNull() & near(pred, gold), "correct").when(pred.isNotNull() & F.exists(others, lambda v: near(pred, v)), "misled").otherwise("other")


def judge_score(t: Column) -> Column:
    """struct(score, ok): the first number from 0 to 1 in the text; 0.5 and not ok without one."""
    found = F.nullif(F.regexp_extract(t, SCORE, 1), F.lit("")).try_cast("double")
    return F.struct(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(found, F.lit(0.5)))).alias("score"), found.isNotNull().alias("ok"))


def sentences(t: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(t, F.lit(SENTENCE), F.lit(0)), lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: s != "")


def words(t: Column) -> Column:
    return F.filter(F.split(t, r"\s+"), lambda w: w != "")


def n_words(t: Column) -> Column:
    return F.size(words(t))


#: Chunk starts that are kept in one array while packing, so that none grows with the text.
STARTS = 256


def pack(parts: Column, most: int) -> Column:
    """Runs of parts joined by a space, each of at most so many words; a part is never split. Parts have single spaces, as sentences() gives them."""
    none = F.array().cast("array<int>")
    start = F.struct(F.array().cast("array<array<int>>").alias("full"), none.alias("starts"), F.lit(0).alias("used"), F.lit(0).alias("i"))

    def step(acc, n):
        opens = (acc["i"] == 0) | (acc["used"] + n > most)
        is_full = F.size(acc["starts"]) >= STARTS
        here = F.array(acc["i"] + 1)
        full = F.when(opens & is_full, F.concat(acc["full"], F.array(acc["starts"]))).otherwise(acc["full"])
        starts = F.when(~opens, acc["starts"]).when(is_full, here).otherwise(F.concat(acc["starts"], here))
        return F.struct(full.alias("full"), starts.alias("starts"), F.when(opens, n).otherwise(acc["used"] + n).alias("used"), (acc["i"] + 1).alias("i"))

    def cut(p):
        sizes = F.transform(p, lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1)
        found = F.aggregate(sizes, start, step, lambda acc: F.concat(F.flatten(acc["full"]), acc["starts"]))
        return let(found, lambda s: F.transform(s, lambda a, k: F.array_join(F.slice(p, a, F.coalesce(F.get(s, k + 1), F.size(p) + 1) - a), " ")))

    return let(parts, cut)


def html_text(t: Column) -> Column:
    """Visible text: script, style and comment blocks dropped, tags turned into spaces, the usual entities decoded, white space squeezed."""
    plain = F.regexp_replace(F.regexp_replace(t, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    for name, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def head_words(t: Column, n: int) -> Column:
    return F.array_join(F.slice(words(t), 1, n), " ")


def numbered(docs: Column) -> Column:
    """Documents as a numbered block of a prompt."""
    return F.array_join(F.transform(docs, lambda d, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), d)), "\n")


def prompt(docs: Column, question: Column) -> Column:
    return F.concat(F.lit("Documents:\n"), numbered(docs), F.lit("\n\nQuestion: "), question, F.lit("\nAnswer:"))


def judge_prompt(document: Column) -> Column:
    return F.concat(F.lit("Rate from 0 to 1 how factual this is.\n"), document, F.lit("\nScore:"))


def safe_id(t: Column) -> Column:
    return F.replace(t, F.lit("/"), F.lit("__"))


def quoted_list(t: Column) -> Column:
    """A list literal with single or double quotes as an array."""
    return F.from_json(t, "array<string>", {"allowSingleQuotes": "true"})
