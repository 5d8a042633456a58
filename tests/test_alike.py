"""Common blocks of two sequences against difflib."""

import difflib
import random
import time

from rankloom.functions import alike


def plain(a, b):
    return sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())


def test_equal_to_difflib():
    rng = random.Random(6)
    for k in range(10_000):
        letters = "abcd"[: rng.randrange(1, 5)] if k % 2 else "abcdefghijklmnopqrst"
        a = [rng.choice(letters) for _ in range(rng.randrange(0, 25))]
        b = list(a) if k % 3 else [rng.choice(letters) for _ in range(rng.randrange(0, 25))]
        for _ in range(rng.randrange(0, 5)):  # a few edits
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(0, 3)] = [rng.choice(letters)] * rng.randrange(0, 3)
        assert alike.common_size(a, b) == plain(a, b), (a, b)


def test_long_ones_in_under_a_second():
    rng = random.Random(7)
    a = [rng.randrange(10**9) for _ in range(20_000)]
    b = a[1:5_000] + [1, 2] + a[5_003:12_000] + a[12_100:]
    began = time.process_time()
    assert alike.common_size(a, b) == len(a) - 1 - 3 - 100
    assert time.process_time() - began < 1.0 * max(1.0, _slowness())


def _slowness():
    t = time.thread_time()
    sum(range(50_000))
    return (time.thread_time() - t) * 1000


def test_odd():
    assert alike.identical_share([], []) == 1.0 and alike.identical_share([], ["a"]) == 0.0 and alike.identical_share(["a", None], [None, "a"]) == 0.5
    assert alike.common_size("xxxxx", "xxx") == 3
