from __future__ import annotations

import numpy as np

from tonearm.llm import mixing as mx


def test_flight_keeps_the_totals():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 50, 2000):
        x = rng.integers(1, 500, n).astype(float)
        p = rng.choice([0.0, 0.3, 0.5, 0.7, 1.0], n)
        q = mx.flight(x, p, 1)
        assert abs(q.sum() - p.sum()) < 1e-6 and abs(q @ x - p @ x) < 1e-4
        assert ((q > 1e-6) & (q < 1 - 1e-6)).sum() <= 2 and (q >= 0).all() and (q <= 1).all()
        assert (q[p == 0] == 0).all() and (q[p == 1] == 1).all()
    same = mx.flight(np.full(100, 7.0), np.full(100, 0.25), 2)
    assert abs(same.sum() - 25) < 1e-6


def test_flight_is_unbiased():
    x, p = np.array([5.0, 9.0, 30.0, 2.0, 14.0, 3.0]), np.array([0.2, 0.5, 0.4, 0.7, 0.3, 0.9])
    mean = np.mean([mx.flight(x, p, s) for s in range(6000)], axis=0)
    assert np.abs(mean - p).max() < 0.03


def test_landing_is_close():
    rng = np.random.default_rng(5)
    x = np.concatenate(([20_000.0, 9_000.0], rng.integers(20, 300, 400)))
    p = np.full(402, 0.37)
    reserve = np.arange(402) >= 200
    q = p.copy()
    q[~reserve] = mx.flight(x[~reserve], p[~reserve], 3)
    done = mx.land(x, q, reserve, 4)
    assert set(done) <= {0.0, 1.0} and abs(done @ x - p @ x) < 300


def _run(spark, docs, targets, **how):
    d = spark.createDataFrame(docs, "id bigint, source string, n_tokens bigint")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    m = mx.mix(d, t, **how)
    return m, {r.source: r for r in mx.shares(m, t).collect()}


def test_shares_and_repeats(spark):
    rng = np.random.default_rng(1)
    docs, i = [], 0
    for s, n in (("big", 6000), ("mid", 900), ("small", 80)):
        for _ in range(n):
            docs.append((i, s, int(rng.integers(20, 400))))
            i += 1
    docs += [(90_001, "big", None), (90_002, "big", 0), (None, "big", 5), (90_003, None, 5), (90_004, "other", 5)]
    targets = [("big", 0.5, 2), ("mid", 0.3, 3), ("small", 0.2, 4), ("absent", 0.1, 1), ("none", 0.0, 9)]
    m, got = _run(spark, docs, targets)
    for s, w in (("big", 0.5), ("mid", 0.3), ("small", 0.2)):
        assert abs(got[s].actual_share - w) < 0.005
    assert got["small"].most_copies == 4 and got["absent"].n_tokens == 0 and got["none"].n_tokens == 0
    assert all(r.copies >= 1 and r.id < 90_000 for r in m.collect())
    assert m.select("id").distinct().count() == m.count()
    again, _ = _run(spark, docs, targets)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in m.collect()}
    _, short = _run(spark, docs, targets, total_tokens=1_500_000.0)
    assert short["small"].most_copies == 4 and short["small"].actual_share < 0.2 and short["mid"].most_copies <= 3


def test_several_blocks_fly_again(spark, monkeypatch):
    monkeypatch.setattr(mx, "BLOCK", 16)
    monkeypatch.setattr(mx, "RESERVE", 20)
    docs = [(i, "a" if i % 4 else "b", 10 + i % 37) for i in range(3000)]
    _, got = _run(spark, docs, [("a", 0.5, 1), ("b", 0.5, 1)])
    assert abs(got["a"].actual_share - 0.5) < 0.003


def test_nothing(spark):
    m, got = _run(spark, [], [("a", 1.0, 1)])
    assert m.count() == 0 and got["a"].n_tokens == 0
    m, got = _run(spark, [(1, "a", 5)], [])
    assert m.count() == 0 and got == {}
