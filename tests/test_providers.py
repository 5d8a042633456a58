"""The stand-in for an embedder hashes each word once."""

import hashlib

from rankloom.operators import providers


def test_embedding_hashes_a_word_once(monkeypatch):
    texts = ["The cat the CAT sat", "", "the dog " * 50, "ß İ x"]

    def plain(t, width):
        v = [0.0] * width
        for w in t.lower().split():
            h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
            v[h % width] += 1.0 if h >> 32 & 1 else -1.0
        size = sum(x * x for x in v) ** 0.5 or 1.0
        return [x / size for x in v]

    want, calls, md5 = [plain(t, 8) for t in texts], [], hashlib.md5
    monkeypatch.setattr(providers.hashlib, "md5", lambda b: calls.append(b) or md5(b))
    assert providers.hashed_embedding(texts, 8) == want
    assert len(calls) == len(set(calls))
