"""Lexical floors fitted through one number a text against a plain fit over the whole vocabulary."""

import re

import numpy as np
import pytest

from rankloom.operators import lexical, sampling, stats


def grams(text):
    words = [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def plain(rows, fold, k=5):
    """id: margin, by Newton steps over all weights and the intercept; rows: (id, text, label)."""
    found = {}
    for f in range(k):
        fit = [r for r in rows if fold[r[0]] != f and r[2] is not None]
        df = {}
        for _, t, _ in fit:
            for g in set(grams(t)):
                df[g] = df.get(g, 0) + 1
        at = {g: i for i, g in enumerate(g for g, n in df.items() if n >= 2)}
        idf = np.array([np.log((len(fit) + 1) / (df[g] + 1)) for g in at])

        def matrix(of):
            x = np.zeros((len(of), len(at)))
            for i, (_, t, _) in enumerate(of):
                for g in grams(t):
                    if g in at:
                        x[i, at[g]] += 1
            x *= idf
            return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

        x, y = matrix(fit), np.array([r[2] > 0 for r in fit])
        w = np.where(y, len(y) / (2 * y.sum()), len(y) / (2 * (~y).sum()))
        mean = w @ x / w.sum()
        std = np.sqrt(w @ (x - mean) ** 2 / (w.sum() - (w * w).sum() / w.sum()))
        on = std > 1e-9
        u, q, b = np.column_stack([x[:, on] / std[on], np.ones(len(y))]), w / w.sum(), np.zeros(on.sum() + 1)
        penalty = np.append(np.full(on.sum(), 0.01), 0.0)
        loss = lambda b: q @ np.logaddexp(0, np.where(y, -1, 1) * (u @ b)) + penalty @ (b * b) / 2
        for _ in range(200):
            p = 1 / (1 + np.exp(-u @ b))
            g = u.T @ (q * (p - y)) + penalty * b
            move, share = np.linalg.lstsq((u * (q * p * (1 - p))[:, None]).T @ u + np.diag(penalty), -g, rcond=None)[0], 1.0
            while share > 1e-6 and loss(b + share * move) > loss(b):
                share /= 2
            b = b + share * move
            if np.abs(g).max() < 1e-12:
                break
        held = [r for r in rows if fold[r[0]] == f]
        z = np.column_stack([matrix(held)[:, on] / std[on], np.ones(len(held))]) @ b
        found |= {r[0]: s for r, s in zip(held, z)}
    return found


def made(n=90, seed=1):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(25)] + ["Été", "straße", "x_y", "数字"]
    rows = []
    for i in range(n):
        y = float(rng.random() < 0.3)
        words = rng.choice(vocabulary, rng.integers(3, 25)).tolist() + (["lure"] if rng.random() < 0.2 + 0.4 * y else [])
        rows.append((i, ", ".join(words), y))
    return rows


def both(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, label double").repartition(3)
    fold = {r.doc_id: r.fold for r in sampling.folds(df, "label", "doc_id", 42, 5).collect()}
    return df, plain(rows, fold)


def test_scores_are_those_of_the_whole_vocabulary(spark):
    rows = made()
    rows += [(200, None, 1.0), (201, "", 0.0), (202, "w1 w2 lure w1", None), (203, rows[0][1], 1.0), (204, rows[0][1], 0.0), (205, "onlyhere onlyhere", 0.0)]
    df, want = both(spark, rows)
    got = lexical.scores(df, "text", "label", "doc_id").collect()
    assert len(got) == len(rows) and sorted((r.y is None, bool(r.y)) for r in got) == sorted((y is None, bool(y)) for _, _, y in rows)
    assert np.allclose(sorted(r.score for r in got), sorted(want.values()), atol=1e-3)
    for side in (True, False):
        assert np.allclose(sorted(r.score for r in got if r.y is side), sorted(want[i] for i, _, y in rows if y is not None and (y > 0) is side), atol=1e-3)


def test_floor_is_that_of_the_fitted_models(spark):
    """The optimum, not where thirty steps end."""
    df, want = both(spark, made(seed=2))
    y = {r.doc_id: r.label > 0 for r in df.collect()}
    up, down = [want[i] for i in want if y[i]], [want[i] for i in want if not y[i]]
    auroc = np.mean([[(a > b) + (a == b) / 2 for b in down] for a in up])
    (row,) = lexical.floor(df, "doc_id").collect()
    assert row.auroc == pytest.approx(auroc, abs=1e-9)


def test_blocks_and_slices_change_nothing(spark, monkeypatch):
    df = spark.createDataFrame(made(60), "doc_id long, text string, label double")
    one = [tuple(r) for r in lexical.scores(df, "text", "label", "doc_id").collect()]
    monkeypatch.setattr(lexical, "WORDS", 30)
    monkeypatch.setattr(lexical, "SLICE", 7)
    monkeypatch.setattr(lexical, "BLOCK", 20)
    two = [tuple(r) for r in lexical.scores(df, "text", "label", "doc_id").collect()]
    assert [y for y, _ in one] == [y for y, _ in two] and np.allclose([s for _, s in one], [s for _, s in two], atol=1e-3)


def test_odd_tables(spark):
    schema = "doc_id long, text string, label double"
    assert lexical.floor(spark.createDataFrame([], schema), "doc_id").collect()[0].auroc is None
    one_sided = lexical.scores(spark.createDataFrame([(i, f"a b {i}", 1.0) for i in range(12)], schema), "text", "label", "doc_id").collect()
    assert len(one_sided) == 12 and not any(r.score for r in one_sided)
    empty = lexical.scores(spark.createDataFrame([(i, "", float(i % 2)) for i in range(12)], schema), "text", "label", "doc_id")
    assert empty.count() == 12 and stats.auroc(empty, [], "score", "y").collect()[0].auroc is not None
