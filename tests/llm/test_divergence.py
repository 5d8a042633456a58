import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from rankloom.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain(rows, least=3, top=200):
    """Dictionaries over all kept terms of all pairs."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]
        key = (lang or "", source or "")
        groups.add(key)
        counts[key].update(terms)
        docs[key[0]].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        sources = sorted(s for of, s in groups if of == lang)

        def p(n):
            total = sum(n[t] for t in kept)
            return {t: 1 + 10**9 * (n[t] + 1) // (total + len(kept)) for t in kept}

        of = {s: p(counts[lang, s]) for s in sources}
        whole = p(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum((of[s][t] - of[o][t]) ** 2 // of[o][t] for t in kept), o) for o in sources if o != s]
            out += [(lang, s, "pair", o, v, k + 1) for k, (v, o) in enumerate(sorted(pairs, key=lambda x: (-x[0], x[1].encode())))]
            terms = [((of[s][t] - whole[t]) ** 2 // whole[t], t) for t in kept if counts[lang, s][t] and of[s][t] > whole[t]]
            out += [(lang, s, "term", t, v, k + 1) for k, (v, t) in enumerate(sorted(terms, key=lambda x: (-x[0], x[1].encode()))[:top])]
    return sorted(out)


def audited(spark, rows, parts=3, **how):
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(parts)
    return sorted(tuple(r) for r in divergence.audit(docs, **how).select("lang", "source", "part", "item", "value", "rank").collect())


def corpus():
    rows = []
    for k in range(160):
        lang, source = "ab"[k % 2], f"s{k % 7}"
        rows.append((" ".join(f"w{chr(97 + (k * j) % 11)}X é{chr(97 + j % (2 + k % 5))}" for j in range(1, 9)) + (" rare" + chr(97 + k % 26) if k % 3 else ""), lang, source))
    return rows


def test_against_plain_version(spark):
    assert audited(spark, corpus()) == plain(corpus())


@pytest.mark.parametrize("block", [1, 2, 3])
def test_blocks_of_sources(spark, monkeypatch, block):
    monkeypatch.setattr(divergence, "BLOCK", block)
    assert audited(spark, corpus()) == plain(corpus())


def test_terms_are_cut_at_the_rank(spark):
    got = audited(spark, corpus(), top=3)
    assert got == plain(corpus(), top=3) and max(r[5] for r in got if r[2] == "term") == 3


def test_odd_rows(spark):
    rows = corpus() + [(None, "a", "s0"), ("", "a", "silent"), ("12 34", None, None), ("tie Tie tIE", "c", None), ("tie", "c", "x"), ("TIE", "c", "x"), ("Éa éa\x00éa  𝔘x", "c", "y"), ("one", "alone", "z")]
    rows += [("copy of a copy", "a", "s1")] * 50 + [("very " + "long wordX " * 200_000 + "tail", "b", "s2"), ("only here", "none kept", "p"), ("or here", "none kept", "q")]
    got = audited(spark, rows)
    assert got == plain(rows)
    assert ("none kept", "p", "pair", "q", 0, 1) in got and not [r for r in got if r[0] == "alone"]
    assert any(r[1] == "silent" and r[2] == "pair" for r in got)


def test_clashing_columns_and_empty_table(spark):
    docs = spark.createDataFrame(corpus(), "text string, lang string, source string").withColumns({c: F.lit("x") for c in ("term", "n", "p", "chunk", "item", "value", "rank", "part")})
    assert sorted(tuple(r) for r in divergence.audit(docs).collect()) == plain(corpus())
    assert divergence.audit(docs.limit(0)).collect() == []


def test_twin(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(con.execute(divergence.SQL).fetchall())
    assert sorted(tuple(r) for r in divergence.query(spark, sf).collect()) == want and want
