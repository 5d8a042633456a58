from collections import Counter, defaultdict

import corpus_pipeline
from test_mixing import plain as plain_mix
from test_packing import plain_best_fit
from test_simhash import plain_components, plain_fingerprint
from tokenizers import Tokenizer

from rankloom.llm import common, langid, packing, secrets


def test_stages_against_plain_versions(spark):
    sf = "/root/testdata/sf0.01"  # the smallest that holds secrets
    docs = common.table(spark, sf, "documents")
    given = {r.doc_id: r for r in docs.collect()}
    out = []
    for _, stage in corpus_pipeline.STAGES:
        docs = common.cut(stage(spark, docs, sf), "test")
        out.append(docs)
    assert all(d.columns == list(next(iter(given.values())).asDict()) for d in out[:4])
    langs, kept, clean, mixed = ([r.asDict() for r in d.collect()] for d in out[:4])

    pred = {r.doc_id: r for r in langid.identify(common.table(spark, sf, "documents")).collect()}
    want = {i for i, r in pred.items() if r.lang_pred != "und" and r.score >= langid.LEAST_SCORE}
    assert {r["doc_id"] for r in langs} == want and len(langs) == len(want)
    assert all(given[r["doc_id"]].text == r["text"] for r in langs)

    label = plain_components({r["doc_id"]: plain_fingerprint(r["text"]) for r in langs})
    assert sorted(r["doc_id"] for r in kept) == sorted(set(label.values()))

    scans = {r.doc_id: r.spans for r in secrets.scan(out[1]).collect()}
    before = {r["doc_id"]: r["text"] for r in kept}
    assert len(clean) == len(kept) and any(scans.values())
    for r in clean:
        text, end, made = before[r["doc_id"]], 0, ""
        for a, b in (tuple(map(int, x.split(":")[1:])) for x in scans[r["doc_id"]].split(",") if x):
            if a >= end:
                made += text[end:a] + secrets.MARK
            end = max(end, b)
        assert r["text"] == made + text[end:] and r["n_chars"] == len(r["text"])

    times = Counter()
    for i, size, _, _, taken in plain_mix([(r["doc_id"], r["source"], r["text"]) for r in clean]):
        if size:
            times[i] += taken // size
    assert Counter(r["doc_id"] for r in mixed) == +times

    plain = Tokenizer.from_file(packing.tokenizer_path())
    lengths, pieces = [], defaultdict(list)
    for r in mixed:
        n = len(plain.encode(r["text"], add_special_tokens=False).ids) + 1
        lengths += [min(2048, n - a) for a in range(0, n, 2048)]
    rows = out[4].collect()
    assert sorted(r.length for r in rows) == sorted(lengths)
    for r in rows:
        pieces[r.sequence_id].append((r.offset, r.length))
    assert len(pieces) == plain_best_fit(lengths, 2048)[0]
    for at in pieces.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(at), sorted(at)[1:])) and min(at)[0] == 0


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
