from __future__ import annotations

import random
from fractions import Fraction

import numpy as np
import pytest

from tonearm.llm import overlap as ov
from tonearm.llm.reading import words


def test_most_edits():
    for t in (Fraction(7, 10), Fraction(1, 2), Fraction(9, 10)):
        for n in range(1, 25):
            for m in range(1, 25):
                for both in range(min(n, m) + 1):
                    edits = n + m - 2 * both
                    assert (edits <= ov.most_edits(n, m, t)) == (Fraction(both, n + m - both) >= t)


def test_banded_distance():
    rng = np.random.default_rng(1)
    a = [np.unique(rng.integers(1, 40, rng.integers(1, 20)).astype(np.uint64)) for _ in range(300)]
    b = [np.unique(np.concatenate((rng.choice(x, max(1, len(x) - rng.integers(0, 4)), False), rng.integers(1, 40, rng.integers(0, 4)).astype(np.uint64)))) for x in a]
    true = np.array([len(set(x) ^ set(y)) for x, y in zip(a, b)])
    for k in (3, 12):
        got = ov.banded_distance(a, b, np.full(300, k))
        assert all((g == t) if t <= k else g > k for g, t in zip(got, true))
    assert len(ov.banded_distance([], [], np.empty(0, int))) == 0


def _corpus(seed, n):
    rng = random.Random(seed)
    common, names = [f"w{i}" for i in range(30)], [f"name{i}" for i in range(400)]
    return [" ".join(rng.sample(common, rng.randint(4, 12)) + rng.sample(names, rng.randint(2, 8))) for _ in range(n)]


@pytest.mark.parametrize("hot", [None, 5])
def test_finds_every_pair(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(ov, "HOT_ROWS", hot)
        monkeypatch.setattr(ov, "RUN_SAMPLE", 100)
    base = _corpus(1, 250)
    rng = random.Random(3)
    train = _corpus(2, 250)
    for s in base[:120]:
        w = s.split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(99)}"
        rng.shuffle(w)
        train.append(" ".join(w))
    train += ["only w1 w2 w3"] * 50 + ["w1 w2 w3 w4 w5 w6 w7 w8 w9"] * 120 + ["", None]
    base += ["w1 w2 w3 w4 w5 w6 w7 w8 w10"] * 30 + ["Ẅ1, w2 W3 w4 w5 w6 w7 w8 w9!"] + [None, ""]
    a = spark.createDataFrame(list(enumerate(base)) + [(0, base[0]), (None, base[0])], "i bigint, p string")
    b = spark.createDataFrame([(i, s, "x") for i, s in enumerate(train)], "j bigint, p string, i string")
    got = {(r.eval, r.train): r.similarity for r in ov.near_same(a, b, "i", "p", "j", "p").collect()}
    sa, sb = ([set(words(s)) for s in side] for side in (base, train))
    want = {}
    for i, x in enumerate(sa):
        for j, y in enumerate(sb):
            if len(x) >= 8 and len(y) >= 8 and 10 * len(x & y) >= 7 * len(x | y):
                want[i, j] = len(x & y) / len(x | y)
    assert len(want) > 3000 and set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_blocks_of_the_query_set(spark, monkeypatch):
    monkeypatch.setattr(ov, "BLOOM_BITS", 1 << 13)
    a = spark.createDataFrame(list(enumerate(_corpus(1, 60))), "i bigint, p string")
    b = spark.createDataFrame(list(enumerate(_corpus(1, 60))), "i bigint, p string")
    got = {(r.eval, r.train) for r in ov.near_same(a, b, "i", "p", "i", "p").collect()}
    assert {(i, i) for i, s in enumerate(_corpus(1, 60)) if len(s.split()) >= 8} <= got


def test_empty_sides_and_long_texts(spark):
    none = spark.createDataFrame([], "i bigint, p string")
    long = " ".join(f"u{i}" for i in range(3000))
    some = spark.createDataFrame([(1, long)], "i bigint, p string")
    assert ov.near_same(none, some, "i", "p", "i", "p").count() == 0
    assert ov.near_same(some, none, "i", "p", "i", "p").count() == 0
    assert ov.near_same(some, some, "i", "p", "i", "p").count() == 1
