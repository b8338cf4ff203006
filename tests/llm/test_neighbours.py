from __future__ import annotations

import math

import numpy as np
import pytest

from tonearm.llm import neighbours as nb


def _exact(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -np.inf)
    return u, s


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    x = np.float32(centres[rng.integers(0, 40, 1500)] + 0.35 * rng.normal(size=(1500, 16)))
    rows = [(i, [float(a) for a in v], "c") for i, v in enumerate(x)]
    return x.astype(float), spark.createDataFrame(rows, "id bigint, v array<float>, vec string")


def test_recall(data, monkeypatch):
    x, df = data
    _, s = _exact(x, 5)
    got = {}
    for r in nb.nearest(df, "id", "v", 16, 5, probes=4).collect():
        got.setdefault(r.id, {})[r.other] = (r.cosine, r["rank"])
    assert set(got) == set(range(1500))
    true = [set(np.argsort(-s[i], kind="stable")[:5]) for i in range(1500)]
    assert sum(len(true[i] & set(got[i])) for i in range(1500)) / 7500 > 0.95
    for i in range(0, 1500, 97):
        assert sorted(r for _, r in got[i].values()) == [1, 2, 3, 4, 5]
        assert all(abs(c - s[i, j]) < 1e-9 for j, (c, _) in got[i].items())
    monkeypatch.setattr(nb, "BLOCK", 50)
    again = {}
    for r in nb.nearest(df, "id", "v", 16, 5, probes=4).collect():
        again.setdefault(r.id, set()).add(r.other)
    assert sum(len(true[i] & again[i]) for i in range(1500)) >= sum(len(true[i] & set(got[i])) for i in range(1500))


def test_least_and_every(data):
    x, df = data
    _, s = _exact(x, 5)
    got = nb.nearest(df, "id", "v", 16, 5, probes=6, least=0.9, every=50).collect()
    assert {r.id % 50 for r in got} == {0} and all(r.cosine >= 0.9 for r in got)
    exact = {(r.id, r.other) for r in nb.exact_nearest(df, "id", "v", 16, 5, every=50, block=7).collect()}
    assert exact == {(i, int(j)) for i in range(0, 1500, 50) for j in np.argsort(-s[i], kind="stable")[:5]}
    want = {(i, j) for i, j in exact if s[i, j] >= 0.9}
    assert len(want & {(r.id, r.other) for r in got}) >= 0.9 * len(want)


def test_anisotropic_codes_favour_the_direction(data):
    x, _ = data
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    index = nb.fit(u, 8, seed=1, threshold=0.5)
    plain = nb.Index(index.centroids, index.books, 1.0)
    home = index.cells(u, 1)[:, 0]
    err = []
    for i in (index, plain):
        code = i.encode(u, home)
        back = index.centroids[home] + index.books[np.arange(code.shape[1])[None], code].reshape(len(u), -1)
        err.append(((back - u) * u).sum(1))
    assert index.eta > 1 and np.square(err[0]).mean() < np.square(err[1]).mean()
    code = index.encode(u[:50], home[:50])
    scan = index.scan(u[:10], nb.pack(code))
    want = u[:10] @ index.books[np.arange(code.shape[1])[None], code].reshape(50, -1).T
    assert np.allclose(scan, want, atol=1e-5)


def test_dirty_vectors_and_copies(spark):
    a, b = [1.0, 0.0, 0.0, 0.0], [0.9, 0.1, 0.0, 0.0]
    rows = [(i, a) for i in range(10)] + [(i, [2 * t for t in a]) for i in range(10, 14)] + [(20, b), (20, b), (21, None), (22, [1.0]), (23, [0.0] * 4), (24, [math.nan] * 4), (25, [math.inf, 0.0, 0.0, 0.0]), (26, [1.0, None, 0.0, 0.0]), (None, a)]
    df = spark.createDataFrame(rows, "id bigint, v array<float>")
    got = {}
    for r in nb.nearest(df, "id", "v", 4, 5).collect():
        got.setdefault(r.id, []).append(r.other)
    assert set(got) == {*range(14), 20}
    assert sorted(got[9]) == [0, 1, 2, 3, 4] and sorted(got[2]) == [0, 1, 3, 4, 5]
    assert sorted(got[20]) == [0, 1, 2, 3, 4]


def test_nothing_and_one(spark):
    df = spark.createDataFrame([], "id bigint, v array<float>")
    assert nb.nearest(df, "id", "v", 4).count() == 0 and nb.exact_nearest(df, "id", "v", 4).count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0])], "id bigint, v array<float>")
    assert nb.nearest(one, "id", "v", 4).count() == 0


def test_two_levels(data, monkeypatch):
    x, df = data
    _, s = _exact(x, 5)
    true = [set(np.argsort(-s[i], kind="stable")[:5]) for i in range(1500)]
    for name, value in (("FLAT", 8), ("CELL_ROWS", 16), ("SAMPLE", 400), ("PARENT_SAMPLE", 200)):
        monkeypatch.setattr(nb, name, value)
    _, classes = nb.direction_classes(df, "id", "v", 16, 6)
    index = nb.fit_on(classes, 16, sample=400, cell_rows=16)
    assert index.parents is not None and len(index.starts) == len(index.parents) + 1 and index.starts[-1] == len(index.centroids) > 60
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = u @ index.centroids.T
    best = index.cells(u, 4)
    assert (best >= 0).all() and (np.diff(np.take_along_axis(sim, best, 1), axis=1) <= 1e-9).all()
    assert (best[:, 0] == sim.argmax(1)).mean() > 0.95
    found = {}
    for r in nb.similar_classes(classes, index, 16, 5, None, 48).collect():
        found.setdefault(r.q, set()).add(r.x)
    assert sum(len(true[i] & found[i]) for i in range(1500)) / 7500 > 0.95
