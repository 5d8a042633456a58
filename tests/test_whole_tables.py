"""Queries cover every row and whole texts, on small tables made for it."""

import difflib
import hashlib
import re

import pytest

from rankloom.operators import providers
from rankloom.plans import catalogue


@pytest.fixture
def made(spark, tmp_path):
    """Writes tables by name, (rows, schema), and gives the folder."""

    def write(**tables):
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def packed(sentences, most):
    out = []
    for s in sentences:
        if out and sum(len(x.split()) for x in out[-1]) + len(s.split()) <= most:
            out[-1].append(s)
        else:
            out.append([s])
    return [" ".join(x) for x in out]


def test_chunk_identity_takes_long_and_null_rows(spark, made):
    long = " ".join(f"Line {k} of {k % 7} words is here, and {'so on ' * (k % 5)}it goes." for k in range(400))
    same = "One common line of a few words. " * 300
    texts = {0: long, 1: long, 3: same, 5: "Short. One.", 7: "", 9: None, 10: None}
    d = made(documents=([(i, t, None if t is None or i == 5 else len(t)) for i, t in texts.items()], "doc_id long, text string, n_chars long"))
    want = {}
    for i, t in texts.items():
        s = [x for x in (" ".join(p.split()) for p in re.findall("[^.!?]+[.!?]*", t or "")) if x]
        a, b = packed(s, 32), packed(s[1:] if i % 2 else s, 32)
        blocks = difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()
        want[i] = round(sum(m.size for m in blocks) / max(len(a), len(b)), 6) if a or b else 1.0
    assert len(long) > 5000 and len(same) > 5000 and want[1] < 1
    got = catalogue.queries()["chunk_identity"](spark, d).collect()
    assert len(got) == len(texts) and {r.doc_id: r.identical for r in got} == want


def test_benchmark_containment_looks_for_whole_items(spark, made):
    item = "The old bridge over the river was repaired after the council had met on Tuesday and agreed at last."
    items = {0: item, 1: "An opening phrase that is shared by some pages and then by an end that no page has.", 2: "two words", 3: item[:60]}
    texts = {
        100: f"Before. {item.upper()} After.",
        101: f"{item[:70]} but then it goes on otherwise.",
        102: f"Only the end: {item[30:]}",
        103: f"{items[1][:50]} something else.",
        104: "It has two words in it.",
        105: None,
    }
    d = made(documents=(list(texts.items()), "doc_id long, text string"), benchmark=(list(items.items()), "item_id long, text string"))
    want = {(i, k) for i, t in texts.items() for k, x in items.items() if t and x.lower() in t.lower()}
    rows = [tuple(r) for r in catalogue.queries()["benchmark_containment"](spark, d).collect()]
    assert sorted(rows) == sorted(want) and want == {(100, 0), (100, 3), (101, 3), (104, 2)}


def test_ab_choice_states_takes_every_document(spark, made):
    ids = range(1000, 1151)
    d = made(documents=([(i, None if i == 1007 else f"text {i} " * 9, "en") for i in ids], "doc_id long, text string, lang string"))
    order = sorted(ids, key=lambda i: (hashlib.md5(f"9:{i}".encode()).hexdigest(), i))
    want = {i: "A" if k + 1 <= len(order) / 2 else "B" for k, i in enumerate(order)}
    got = catalogue.queries()["ab_choice_states"](spark, d).collect()
    assert len(got) == len(order) and {r.doc_id: r.side for r in got} == want and {r.layers for r in got} == {3}


def test_provider_judge_reads_whole_texts(spark, made):
    texts = {k: "The same long beginning of a text. " * 8 + f"End {k}." for k in range(1, 40, 2)} | {2: "cached.", 3: "cached.", 4: None}
    d = made(documents=(list(texts.items()), "doc_id long, text string"))
    asked = {i: f"Rate from 0 to 1 how factual this is.\n{t or ''}\nScore:" for i, t in texts.items()}
    want = {i: "0.25" if i in (2, 3, 4) else providers.judge([p])[0] for i, p in asked.items()}
    got = catalogue.queries()["provider_judge"](spark, d).collect()
    assert len(got) == len(texts) and {r.doc_id: r.raw for r in got} == want and len(set(want.values())) > 5


def test_a_corpus_is_versioned_in_parts_of_bounded_size(spark, sf, monkeypatch):
    """The second layout is not a stated number of parts, which would grow with the table."""
    from pyspark.sql import DataFrame

    asked, plain = [], DataFrame.repartition
    monkeypatch.setattr(type(spark.range(1)), "repartition", lambda self, *how: asked.append(how) or plain(self, *how))
    rows = catalogue.queries()["corpus_version"](spark, sf).collect()
    assert {(r.version, r.matches) for r in rows} == {("same", True), ("other", False)} and not any(isinstance(h[0], int) for h in asked)
