"""Runs of words against brute force over all periods, planted repetitions, and odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchgrid.llm import word_runs


def brute_runs(w, least=24, periods=3):
    found = {}
    for p in range(1, len(w) // periods + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            start = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i - start + p >= max(least, periods * p):
                found.setdefault((start, i + p), p)
    return sorted((a, b - a, p) for (a, b), p in found.items())


def brute_collapse(w, runs):
    dropped = {i for a, n, p in runs for i in range(a + p, a + n)}
    return " ".join(x for i, x in enumerate(w) if i not in dropped)


def some_words(rnd):
    """Words of a small alphabet with a periodic stretch, tripled now and then, or one word over and over."""
    k = rnd.choice([1, 2, 3, 30])
    w = [f"w{rnd.randrange(k)}" for _ in range(rnd.randint(0, 150))]
    if w and rnd.random() < 0.6:
        a, p = rnd.randrange(len(w)), rnd.randint(1, 12)
        for i in range(a + p, min(len(w), a + rnd.randint(10, 120))):
            w[i] = w[i - p]
    return w * 3 if rnd.random() < 0.2 else w


@pytest.mark.parametrize("least, periods", [(24, 3), (6, 2), (12, 3), (3, 3), (40, 4)])
def test_maximal_pairs_are_the_runs(least, periods):
    rnd = random.Random(least)
    for _ in range(150):
        texts = [some_words(rnd) for _ in range(rnd.randint(1, 4))]
        first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        keys = np.array([int(x[1:]) for t in texts for x in t], np.uint64)
        got = sorted(map(tuple, word_runs.maximal_pairs(keys, first, least, periods).tolist()))
        assert got == sorted((t, *r) for t, w in enumerate(texts) for r in brute_runs(w, least, periods))


def test_runs_and_collapsed_texts(spark):
    rnd = random.Random(8)
    texts = [None, "", " \n\t ", "one", "A a " * 30, "a " * 24, "a " * 23, "x y z\n" * 8 + "x y", "é ü " * 20 + "  b"]
    texts += [" ".join(some_words(rnd)) for _ in range(120)]
    texts += ["\t".join(["over", "and", "out"] * 3000), " ".join(f"v{i % 997}" for i in range(4000)), texts[7], texts[7]]
    rows = [(i if i != 5 else None, t, "gone", "kept") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, extra string")
    done = word_runs.find_runs(docs)
    assert done.columns == ["doc_id", "text", "extra", "n_words", "runs", "top", "collapsed"]
    for r in done.collect():
        w = [x for x in (r.text or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
        runs = brute_runs(w) if len(w) < 3000 else [tuple(x) for x in r.runs]
        best = max(range(len(runs)), key=lambda i: (runs[i][1] / runs[i][2], -runs[i][0])) if runs else None
        assert (r.n_words, [tuple(x) for x in r.runs], r.top, r.collapsed) == (len(w), runs, best, brute_collapse(w, runs))
        if len(w) == 9000:
            assert runs == [(0, 9000, 3)]
        if len(w) == 4000:
            assert runs == [(0, 4000, 997)]
    assert word_runs.find_runs(docs.limit(0)).collect() == []


def test_planted_repetition_and_no_doc_id(spark):
    docs = spark.createDataFrame([(" ".join(f"v{i}" for i in range(200)), 10 ** 9 + 7 * k) for k in range(8)] + [("a b", None), ("", 5), (None, 7)], "text string, seed long")
    for r in word_runs.find_runs(docs, repeat_seed=F.col("seed")).collect():
        if r.n_words == 200:
            a, p = r.seed % 200, 1 + (200 - r.seed % 200) // (3 + r.seed % 8)
            w = [f"v{i if i < a else a + (i - a) % p}" for i in range(200)]
            assert [tuple(x) for x in r.runs] == brute_runs(w) and r.collapsed == brute_collapse(w, brute_runs(w))
        else:
            assert r.runs == [] and r.collapsed == (r.text or "")


def test_one_word_over_and_over_is_not_quadratic():
    keys = np.ones(20_000, np.uint64)
    assert word_runs.maximal_pairs(keys, np.array([0, 20_000]), 24, 3).tolist() == [[0, 0, 20_000, 1]]
    stretch = np.concatenate([np.append(np.ones(100, np.uint64), np.uint64(i + 2)) for i in range(300)])
    assert len(word_runs.maximal_pairs(stretch, np.array([0, len(stretch)]), 24, 3)) == 300
