from __future__ import annotations

import math
import random

import numpy as np
import pytest

from tonearm.operators import attribution as at
from tonearm.operators import vectors as vx

D = 8


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, D))
    x[100:160] = x[:60] + 0.05 * rng.normal(size=(60, D))
    x[200:230] = x[0]
    rows = [(i, i % 5, [float(a) for a in np.float32(v)]) for i, v in enumerate(x)]
    return np.float32(x).astype(float), spark.createDataFrame(rows + [(900, 1, None), (901, 1, [0.0] * D)], "id bigint, label int, v array<float>")


def _unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _greedy(n, similar):
    dropped = {}
    for i in range(n):
        if i not in dropped:
            for j in range(i + 1, n):
                if j not in dropped and similar(i, j):
                    dropped[j] = i
    return dropped


def test_similar_pairs(vectors):
    x, df = vectors
    s = _unit(x) @ _unit(x).T
    for t in (0.9, 0.5):
        want = {(i, j) for i in range(300) for j in range(i + 1, 300) if s[i, j] >= t}
        got = {(r.a, r.b) for r in vx.similar_pairs(df, "id", "v", t).collect()}
        assert got == want


def test_dedup_with_copies(vectors):
    x, df = vectors
    s = _unit(x) @ _unit(x).T
    got = {r.drop: r.keep for r in vx.dedup(df, "id", "v", 0.9).collect()}
    assert got == _greedy(300, lambda i, j: s[i, j] >= 0.9)


def test_greedy_on_graphs(spark):
    for seed in range(6):
        rng = random.Random(seed)
        edges = {(i, j) for i in range(30) for j in range(i + 1, 30) if rng.random() < 0.08}
        df = spark.createDataFrame([(a, b, 1.0) for a, b in edges], "a bigint, b bigint, similarity double")
        got = {r.drop: r.keep for r in vx.greedy_keep_first(df).collect()}
        assert got == _greedy(30, lambda i, j: (i, j) in edges)
    assert vx.greedy_keep_first(df.limit(0)).count() == 0
    chain = spark.createDataFrame([(0, 1, 0.9), (1, 2, 0.9)], "a bigint, b bigint, similarity double")
    assert [tuple(r) for r in vx.greedy_keep_first(chain).collect()] == [(1, 0, 0.9)]


def test_kernel_scores(vectors):
    x, df = vectors
    train, queries = df.where("id between 10 and 299"), df.where("id < 10")
    k = x[10:300, :6].T @ x[10:300, :6] + 0.1 * np.eye(6)
    want = -x[:10, :6] @ np.linalg.inv(k) @ x[10:300, :6].T
    got = at.kernel_scores(train, queries, "id", "id", "v", 6, 0.1, negate=True, block=4).collect()
    assert len(got) == 2900
    assert max(abs(r.score - want[r.query, r.train - 10]) for r in got) < 1e-9


def test_geometry(vectors):
    x, df = vectors
    ok = df.where("id < 300")
    lab = np.arange(300) % 5
    coh = {r.label: r.coherence for r in vx.coherence(ok, "label", "v").collect()}
    u = _unit(x)
    for k in range(5):
        s = u[lab == k] @ u[lab == k].T
        n = len(s)
        assert math.isclose(coh[k], (s.sum() - np.trace(s)) / (n * (n - 1)), rel_tol=1e-9)
    one = ok.where("id = 3")
    assert vx.coherence(one, "label", "v").first().coherence == 1.0
    r = vx.distinctiveness(vx.centroids(one, "label", "v"), "label").first()
    assert abs(r.to_grand) < 1e-12 and r.to_nearest == 1.0


def test_distances_of_sets(vectors):
    x, df = vectors
    a, b = df.where("id < 100"), df.where("id between 100 and 299")
    m1, m2, c1, c2 = x[:100].mean(0), x[100:].mean(0), np.cov(x[:100].T), np.cov(x[100:].T)
    w = np.sqrt(np.linalg.eigvals(c1 @ c2).astype(complex)).real.sum()
    want = (m1 - m2) @ (m1 - m2) + np.trace(c1) + np.trace(c2) - 2 * w
    assert math.isclose(vx.frechet_distance(a, b, "v", D), want, rel_tol=1e-7)
    assert abs(vx.frechet_distance(a, a, "v", D)) < 1e-7
    assert vx.frechet_distance(a.limit(1), b, "v", D) is None
    assert abs(vx.discrepancy(a, a, "v")) < 1e-12 and vx.discrepancy(a.limit(0), b, "v") is None
    d2 = ((x[:100, None] - x[None, :100]) ** 2).mean(2)
    assert math.isclose(vx.kernel_mean(a, a, "v", "gaussian", block=30), np.exp(-d2 / D).mean(), rel_tol=1e-9)


def test_projection_and_histogram(vectors, spark):
    x, df = vectors
    p = np.array([r.projection for r in vx.projected(df.where("id < 300"), "v", D, 3).orderBy("id").collect()])
    c = x - x.mean(0)
    s = np.linalg.svd(c, compute_uv=False)
    assert np.allclose((p**2).sum(0), s[:3] ** 2, rtol=1e-6)
    h = vx.histogram(spark.createDataFrame([(float(i),) for i in range(11)] + [(None,)], "v double"), "v", 5).orderBy("bin").collect()
    assert [r.n for r in h] == [2, 2, 2, 2, 3]
    assert vx.histogram(spark.createDataFrame([], "v double"), "v", 5).count() == 0
    logs = vx.histogram(spark.createDataFrame([(1.0,), (9.0,), (99.0,)], "v double"), "v", 2, log=True).orderBy("bin").collect()
    assert [r.n for r in logs] == [2, 1]


def test_code_out_of_range(spark):
    df = spark.createDataFrame([(1, 0, 40)], "k int, b int, c int")
    with pytest.raises(Exception, match="code book"):
        vx.code_histogram(df, "k", "b", "c", 32).collect()


def test_similar_pairs_of_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 12))
    x = centres[rng.integers(0, 30, 1200)] + 0.25 * rng.normal(size=(1200, 12))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(s >= 0.9, 1)))}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>")
    for name, value in (("SUBBLOCK", 50), ("SENT_BLOCKS", 7)):
        monkeypatch.setattr(vx, name, value)
    got = vx.similar_pairs(df, "id", "v", 0.9).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want) > 500
    assert all(abs(r.similarity - s[r.a, r.b]) < 1e-12 for r in got)
