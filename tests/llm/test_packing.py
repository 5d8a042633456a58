import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rankloom.llm import packing


def plain_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [(room, i) for i, room in enumerate(bins) if room >= n]
        if fits:
            bins[min(fits)[1]] -= n
        else:
            bins.append(capacity - n)
    return len(bins), sorted(bins)


def test_plan_equals_piece_by_piece():
    rng = random.Random(3)
    for capacity in (1, 7, 16, 64, 100):
        for _ in range(40):
            lengths = [min(capacity, max(1, int(rng.expovariate(4 / capacity)))) for _ in range(rng.randint(0, 120))]
            counts = Counter(lengths)
            steps, bins = packing.pack(counts, capacity)
            starts = defaultdict(list)
            for s in sorted(steps):
                starts[s[0]].append(s)
            used = defaultdict(list)
            for n, c in counts.items():
                for k in range(c):
                    _, first, each, start, at = [s for s in starts[n] if s[1] <= k][-1]
                    used[start + (k - first) // each].append((at + (k - first) % each * n, n))
            for at in used.values():
                end = 0
                for a, n in sorted(at):
                    assert a == end
                    end += n
                assert end <= capacity
            want, rooms = plain_best_fit(lengths, capacity)
            assert bins == want == len(used)
            assert sorted(capacity - sum(n for _, n in x) for x in used.values()) == rooms


def test_words_equal_whole_texts(sf, spark):
    path = packing.tokenizer_path()
    own, plain = packing.WordTokenizer(path), Tokenizer.from_file(path)
    odd = ["", " \n", "Don't it's we'll I'M", "á e ́x ÉÀ ﬁ İ ΣΑΣ ſ", "x\x1cy \x1f\x85z w v", "<|endoftext|> a<|startoftext|>b", "____ --- ... 'tis 12,345.67 9a8", "日本語 テスト 한국어", "a" * 3000, "한 ̀a", "it's they're ''s 'sx !'s 's's I'LL", "<|endoftext", "naïve_word? (yes)!! word### Größe&&& ÿ× ÷"]
    texts = odd + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rng = random.Random(4)
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 90))) for letters in ("abcdehinorst", "etaoin'srdlm 012.,!?-/_<>|éÉßÿ÷×ñÑ  \n\t", "the \x0b\x0c\r!") for _ in range(3000)]
    assert own.merges is not None  # otherwise every text would go to the tokenizer
    for _ in range(2):  # new words, then known ones
        for text, got in zip(texts, own.ids([t.encode() for t in texts])):
            assert got.tolist() == plain.encode(text, add_special_tokens=False).ids, text[:50]


def test_whole_table(spark, sf):
    plain = Tokenizer.from_file(packing.tokenizer_path())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = packing.query(spark, sf).collect()
    by, seqs = defaultdict(dict), defaultdict(list)
    for r in rows:
        by[r.doc_id][r.piece] = r
        seqs[r.sequence_id].append((r.offset, r.length))
    lengths = []
    for i, t in texts.items():
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert sorted(by[i]) == list(range(-(-len(ids) // 2048)))
        for k, r in by[i].items():
            part = ids[2048 * k : 2048 * (k + 1)]
            assert (r.start, r.length, r.ids_crc32) == (2048 * k, len(part), zlib.crc32(part.tobytes()))
            lengths.append(len(part))
    for at in seqs.values():
        end = 0
        for a, n in sorted(at):
            assert a == end
            end += n
        assert end <= 2048
    assert len(seqs) == plain_best_fit(lengths, 2048)[0]


def test_odd_rows(spark):
    rows = [(1, None), (1, None), (2, ""), (None, "abc"), (3, "long " * 6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("x")).withColumn("bucket", F.lit(1))
    got = packing.pack_documents(docs).collect()
    assert sorted((r.doc_id or 0, r.piece, r.length) for r in got) == [(0, 0, 2), (1, 0, 1), (1, 0, 1), (2, 0, 1), (3, 0, 2048), (3, 1, 2048), (3, 2, 1905)]
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    assert packing.pack_documents(docs.limit(0)).collect() == []
