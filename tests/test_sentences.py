"""Abbreviations and sentence spans."""

import math
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankloom.operators import sentences


def corpus():
    out = []
    for k in range(120):
        out.append(f"Dr. Smith met Mrs. Jones at {k}.5 degrees. They spoke of the plan, e.g. the house. The house was old.\nIt rained! \"Was it?\" she asked. On the {k}. of May, J. K. Rowe left.")
        out.append(f"The garden is green. A cat sat by the door. Nobody knows the garden. We met the doctor and the plan failed {k}. A green cat asked the old man in the house by the door of the garden for a few degrees more, and left again early.")
    return out


def plain_scores(texts):
    n, stops = Counter(), Counter()
    for t in texts:
        for w in t.split():
            w = w.lstrip("(\"'[«„“‘").rstrip(")\"']»”’")
            kind = re.sub(r"\.$", "", w).lower()
            if any(c.isalpha() for c in kind):
                n[kind] += 1
                stops[kind] += w.endswith(".")
    rate = sum(stops.values()) / sum(n.values())
    out = {}
    for k in n:
        if stops[k]:
            without, letters = n[k] - stops[k], len(k.replace(".", ""))
            chance = stops[k] * math.log(rate) + without * math.log(1 - rate)
            tied = stops[k] * math.log(0.99) + without * math.log(0.01)
            out[k] = -2 * (chance - tied) * math.exp(-letters) * (len(k) - letters + 1) * float(letters) ** -without
    return {k: s for k, s in out.items() if s >= sentences.THRESHOLD}


def test_abbreviations_against_plain(spark):
    got = {r.type: r.score for r in sentences.abbreviations(spark.createDataFrame([(t,) for t in corpus()] + [(None,)], "t string"), "t").collect()}
    assert got == pytest.approx(plain_scores(corpus()))
    assert {"dr", "mrs", "e.g"} <= set(got) and not {"house", "old", "garden", "door", "degrees"} & set(got)


def test_spans(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(corpus())] + [(900, None), (901, ""), (902, " \n\t ")], "id long, t string").repartition(3)
    got = {r.id: r for r in sentences.split(df, "t", sentences.abbreviations(df, "t")).collect()}
    assert got[900].sentences is None and got[901].sentences == [] and got[902].sentences == []
    for k, t in enumerate(corpus()):
        parts = [t[s.start : s.end] for s in got[k].sentences]
        at = 0
        for s in got[k].sentences:
            assert t[at : s.start].strip() == ""
            at = s.end
        assert t[at:].strip() == "" and all(p == p.strip() and p for p in parts)
        if k % 2 == 0:
            assert parts == [f"Dr. Smith met Mrs. Jones at {k // 2}.5 degrees.", "They spoke of the plan, e.g. the house.", "The house was old.", "It rained!", '"Was it?"', "she asked.", f"On the {k // 2}. of May, J. K. Rowe left."]


def test_splitting_rules():
    cut = lambda t, known=frozenset(): [t[a:b] for a, b in sentences.spans(t, known)]
    assert cut("No stop") == ["No stop"]
    assert cut("One.  Two…\n\nThree no stop\n \nFour?! (Five.) Six") == ["One.", "Two…", "Three no stop", "Four?!", "(Five.)", "Six"]
    assert cut("See vol. 3, 2.5 and 7. it says.", {"vol"}) == ["See vol. 3, 2.5 and 7. it says."]
    assert cut("He left etc.", {"etc"}) == ["He left etc."] and cut("He left etc.\n\nThen", {"etc"}) == ["He left etc.", "Then"]
    assert cut("a.b.c. d") == ["a.b.c.", "d"]


def test_long_text():
    text = "word " * 200_000 + "end. " + "x" * 300_000 + ". Done."
    parts = sentences.spans(text, set())
    assert len(parts) == 3 and text[slice(*parts[-1])] == "Done."


def test_spans_of_large_batches_are_made_in_slices(monkeypatch):
    """However many texts a batch has, the spans of a bounded part of them are held at once."""
    monkeypatch.setattr(sentences, "TEXT", 100)
    texts = ["One. Two.", None, "", "Three! " * 40, "Four.", None] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["id", "t"])
    got = list(sentences._split_batches(iter([batch, batch.slice(0, 0)]), 1, set(), "s"))
    assert len(got) == 4 and [x for b in got for x in b.column(0).to_pylist()] == list(range(len(texts)))
    assert [x for b in got for x in b.column(2).to_pylist()] == [None if t is None else [{"start": s, "end": e} for s, e in sentences.spans(t, set())] for t in texts]
