"""Best-fit decreasing packing of tokenized documents into sequences of fixed capacity.

Lengths are whole numbers up to the capacity, so best-fit decreasing needs no more than a count of pieces by length: all
pieces of one length are placed together, range of bins by range of bins. Open bins are kept by remaining capacity under
a segment tree, which gives the tightest bin that a piece fits in logarithmic time. The outcome is that of placing the pieces
one by one. The plan has a bounded number of steps whatever the number of documents; the driver holds the plan
and the histogram, never pieces. Executors number the pieces of each length (by hash bucket, so that a length with a third of all
pieces is no single group) and look each number up in the plan.

Defined results: null text is the empty text, whose document is the closing id alone; repeated rows are packed each for
itself; null ids stay null; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship
from . import common

CAPACITY = 2048
END_ID = 0
#: Hash buckets in which the pieces of one length are numbered.
BUCKETS = 4096
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Words that a worker remembers, bytes that are tokenized together, and the size that marks a word to be left to the tokenizer.
KNOWN_WORDS, TOGETHER, ODD = 500_000, 1_000_000, -1


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Merges:
    """Byte-pair merging of many pieces at once: in each round every piece merges its pair of least rank, the leftmost if it has several."""

    NONE = np.iinfo(np.int32).max

    def __init__(self, vocab: dict[str, int], merges: list, end: str):
        letters = _byte_letters()
        self.first = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + end] for c in letters], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        want = (a.astype(np.int64) << 32) | b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where((self.keys[at] == want) & (b >= 0), self.ranks[at], self.NONE)

    def _same_width(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        sym = np.full((len(size), width + 1), -1, np.int32)  # the last column is never used
        column = np.arange(width + 1)
        sym[column < size[:, None]] = self.first[data[_stretches(start, size)]]
        sym[np.arange(len(size)), size - 1] = self.last[data[start + size - 1]]
        rank = self._rank(sym[:, :-1], sym[:, 1:])
        live = np.arange(len(size))
        while len(live):
            s, r = sym[live], rank[live]
            at = r.argmin(axis=1)
            best = r[np.arange(len(live)), at]
            go = best < self.NONE
            live, s, r, at, best = live[go], s[go], r[go], at[go], best[go]
            row, after = np.arange(len(live)), column[:-1] > at[:, None]
            s[:, :-1] = np.where(after, s[:, 1:], s[:, :-1])
            s[row, at] = self.merged[best]
            r[:, :-1] = np.where(after[:, :-1], r[:, 1:], r[:, :-1])
            r[row, at] = self._rank(s[row, at], s[row, at + 1])
            before = at > 0
            r[row[before], at[before] - 1] = self._rank(s[row[before], at[before] - 1], s[row[before], at[before]])
            sym[live], rank[live] = s, r
        kept = sym >= 0
        return sym[kept].astype(np.uint32), kept.sum(axis=1)

    def __call__(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in a row, number of ids of each) of the pieces that lie in data at these places."""
        sizes, parts = np.zeros(len(size), np.int64), []
        for k in range(int(size.max(initial=0)).bit_length() + 1):  # widths of 1, 2, 4, 8 and so on
            mine = np.flatnonzero((size <= 1 << k) & (size > (1 << k) // 2))
            if len(mine):
                ids, sizes[mine] = self._same_width(data, start[mine], size[mine], 1 << k)
                parts.append((mine, ids))
        flat = np.zeros(int(sizes.sum()), np.uint32)
        first = np.cumsum(sizes) - sizes
        for mine, ids in parts:
            flat[_stretches(first[mine], sizes[mine])] = ids
        return flat, sizes


def _byte_letters() -> list[str]:
    """The characters that stand for the bytes 0 to 255 in byte-level vocabularies: printable ones stand for themselves, the others come from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + others.index(b)) for b in range(256)]


def _stretches(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places start, start + 1 and so on, size of them, for one stretch after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class WordTokenizer:
    """ids of whole texts, the same as the tokenizer's own, with a memory of the words met.

    The tokenizer's pattern never joins what ASCII white space parts, so a text is split there, as bytes, and each word is
    looked up by its lower-cased bytes in a dictionary that numbers new words as they come; their ids are learned together
    afterwards. A word that may be more than the pattern tells (characters beyond ASCII and Latin-1 letters, control characters,
    a special token, very long ones) is odd, and a text with an odd word goes to the tokenizer as it is; so does every text if the
    tokenizer is of another make.
    """

    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]{0,64}")
    PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+|\t")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.special = [t["content"].lower() for t in made["added_tokens"]]
        model, steps = made["model"], (made.get("pre_tokenizer") or {}).get("pretokenizers") or []
        known = [n["type"] for n in (made.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in steps] == ["Split", "ByteLevel"]
        known = known and steps[0]["pattern"] == {"Regex": self.SPLIT} and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
        known = known and model["type"] == "BPE" and not (model["continuing_subword_prefix"] or model["dropout"] or model["ignore_merges"])
        self.merges = Merges(model["vocab"], model["merges"], model["end_of_word_suffix"] or "") if known else None
        self.forget()

    def forget(self) -> None:
        self.known = _Numbers()
        # the first id and the number of ids of each word in flat; ODD in place of a number
        self.starts, self.sizes, self.flat = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32), np.zeros(1 << 14, np.uint32)
        self.n_words = self.n_ids = 0

    def _encode(self, text: bytes) -> np.ndarray:
        return np.array(self.own.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)

    def _learn(self) -> None:
        """ids of the words that were numbered since the last call."""
        new, self.known.new = self.known.new, []
        for k in range(0, len(new), 1 << 14):
            text = b"\t".join(new[k : k + (1 << 14)]).decode("utf-8", "replace").lower()
            some = text.split("\t")
            plain = [self.PLAIN.fullmatch(w) is not None for w in some]
            if any(x in text for x in self.special):
                plain = [p and not any(x in w for x in self.special) for w, p in zip(some, plain)]
            # pieces, and a tab at the end of each word, one a line
            lines = "\n".join(self.PIECE.findall("\t".join([w if p else "" for w, p in zip(some, plain)]) + "\t")) + "\n"
            data = np.frombuffer(lines.encode(), np.uint8)
            end = np.flatnonzero(data == 10)
            start = np.concatenate(([0], end[:-1] + 1))
            tab = data[start] == 9
            ids, sizes = self.merges(data, start[~tab], (end - start)[~tab])
            last = np.flatnonzero(tab) - np.arange(len(some))  # pieces up to the end of each word
            ends = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], last))]
            n, m = self.n_words + len(some), self.n_ids + len(ids)
            self.starts, self.sizes, self.flat = _room(self.starts, n), _room(self.sizes, n), _room(self.flat, m)
            self.flat[self.n_ids : m] = ids
            self.starts[self.n_words : n], self.sizes[self.n_words : n] = self.n_ids + ends[:-1], np.where(plain, np.diff(ends), ODD)
            self.n_words, self.n_ids = n, m

    def ids(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """ids of texts in UTF-8."""
        if self.merges is None:
            yield from map(self._encode, texts)
            return
        if self.n_words > KNOWN_WORDS:
            self.forget()
        words = [t.lower().split() for t in texts]
        n_words = np.fromiter(map(len, words), np.int64, len(words))
        k = np.fromiter(map(self.known.__getitem__, chain.from_iterable(words)), np.int32, int(n_words.sum()))
        del words
        self._learn()
        size, ends = self.sizes[k], np.concatenate(([0], np.cumsum(n_words)))
        odd = set((np.searchsorted(ends, np.flatnonzero(size == ODD), "right") - 1).tolist())
        size = np.maximum(size, 0)
        flat = self.flat[_stretches(self.starts[k], size)]
        ends = np.concatenate(([0], np.cumsum(size)))[ends]
        for i, text in enumerate(texts):
            yield self._encode(text) if i in odd else flat[ends[i] : ends[i + 1]]


class _Numbers(dict):
    """Numbers words from 0 as they are looked up; those new since new was last emptied are in it."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = k = len(self)
        self.new.append(word)
        return k


def _room(array: np.ndarray, n: int) -> np.ndarray:
    return array if len(array) >= n else np.concatenate((array, np.zeros(max(n, 2 * len(array)) - len(array), array.dtype)))


@cache
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def _together(texts: Iterable[bytes]) -> Iterator[list[bytes]]:
    """Runs of texts of about TOGETHER bytes."""
    run, n = [], 0
    for t in texts:
        run.append(t)
        n += len(t)
        if n >= TOGETHER:
            yield run
            run, n = [], 0
    if run:
        yield run


def _cutter(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _tokenizer(path)
        for b in batches:
            doc_ids, texts = b.column(0), (t.as_py() or b"" for t in b.column(1))
            row, piece, start, length, crc = [], [], [], [], []
            k = 0
            for some in _together(texts):
                for ids in own.ids(some):
                    ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                    for i, at in enumerate(range(0, len(ids), capacity)):
                        part = ids[at : at + capacity]
                        row.append(k)
                        piece.append(i)
                        start.append(at)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                    k += 1
            yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents cut only where they are longer than the capacity."""
    ship(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("binary").alias("text")).mapInArrow(_cutter(path, capacity), PIECES)


class FreeSpace:
    """Ranges of open bins by remaining capacity, under a segment tree that finds the least capacity that suffices."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.leaves)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(self.leaves)]

    def _mark(self, r: int) -> None:
        k, here = r + self.leaves, bool(self.ranges[r])
        while k and self.any[k] != here:
            self.any[k] = here
            k //= 2
            here = self.any[2 * k] or self.any[2 * k + 1] if k else here

    def put(self, r: int, start: int, n: int) -> None:
        if n:
            self.ranges[r].append((start, n))
            self._mark(r)

    def pop(self, r: int) -> tuple[int, int]:
        found = self.ranges[r].pop()
        self._mark(r)
        return found

    def tightest(self, length: int) -> int | None:
        k = length + self.leaves
        if self.any[k]:
            return length
        while k > 1:  # up to the first right sibling that holds anything, then down its left edge
            if k % 2 == 0 and self.any[k + 1]:
                k += 1
                while k < self.leaves:
                    k = 2 * k if self.any[2 * k] else 2 * k + 1
                return k - self.leaves
            k //= 2
        return None


def pack(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing of counts[length] pieces each.

    Steps (length, first number, pieces a bin, first bin, place in it) and the number of bins. Pieces of a length are numbered
    from 0; a step holds up to the next step of its length.
    """
    free, bins, steps = FreeSpace(capacity), 0, []
    for length in sorted((x for x in counts if counts[x]), reverse=True):
        left, number = counts[length], 0
        while left:
            room = free.tightest(length)
            if room is None:
                room = capacity
                start, n = bins, -(-left // (capacity // length))
                bins += n
            else:
                start, n = free.pop(room)
            each = room // length  # a bin just used stays the tightest as long as another piece fits
            full = min(n, left // each)
            if full:
                steps.append((length, number, each, start, capacity - room))
                free.put(room - each * length, start, full)
                number, left, start, n = number + full * each, left - full * each, start + full, n - full
            if n and left and left < each:
                steps.append((length, number, left, start, capacity - room))
                free.put(room - left * length, start, 1)
                number, left, start, n = number + left, 0, start + 1, n - 1
            free.put(room, start, n)
    return steps, bins


def _places(steps: list[tuple[int, int, int, int, int]]):
    length, number, each, start, at = (np.array(x, np.int64) for x in zip(*sorted(steps))) if steps else (np.zeros(0, np.int64),) * 5
    keys = (length << 44) + number

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, n = b.column("length").to_numpy(), b.column("number").to_numpy()
            k = np.searchsorted(keys, (size << 44) + n, "right") - 1
            j = n - number[k]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(start[k] + j // each[k]), pa.array(at[k] + j % each[k] * size)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def place(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces() with sequence_id and offset."""
    bucketed = cut_pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(BUCKETS)).cast("int"))
    hist = bucketed.groupBy("length", "bucket").count()
    before = hist.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count")).drop("count")
    steps, _ = pack({r["length"]: r["n"] for r in cut_pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}, capacity)  # at most `capacity` rows
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "start")) - 1
    numbered = bucketed.withColumn("own", own).join(before, ["length", "bucket"]).withColumn("number", F.col("before") + F.col("own"))
    out = f"{PIECES}, sequence_id long, offset long"
    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "number").mapInArrow(_places(steps), out)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for every piece of every row of docs: (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    return place(common.cut(pieces(docs, path or tokenizer_path(), capacity, id_col, text_col), "pieces"), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.table(spark, sf_dir, "documents"))
