from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest

from tonearm.operators import stats as st


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(6):
        x = np.round(rng.normal(size=12), 1)
        y = np.round(0.5 * x + rng.normal(size=12), 1)
        rows += [(k, i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    rows += [(10, i, 1.0, float(i)) for i in range(4)] + [(11, i, float(i), 2.0) for i in range(4)] + [(12, 0, 1.0, 3.0)] + [(13, i, float(i), 2.0 * i) for i in range(4)]
    return rows, spark.createDataFrame(rows, "k int, i int, x double, y double")


def test_estimates(frame):
    rows, df = frame
    got = {r.k: r for r in st.estimates(df, ["k"], "x", "y").collect()}
    for k in range(6):
        x, y = (np.array([r[j] for r in rows if r[0] == k]) for j in (2, 3))
        cov = np.cov(x, y)
        kk = cov[0, 1] / cov[1, 1]
        assert math.isclose(got[k].i_hat, cov[0, 1] / cov[0, 0], rel_tol=1e-9)
        assert math.isclose(got[k].k_hat, kk, rel_tol=1e-9)
        assert math.isclose(got[k].spearman, np.corrcoef(pd.Series(x).rank(), pd.Series(y).rank())[0, 1], rel_tol=1e-9)
        assert math.isclose(got[k].snr, np.var(y, ddof=1) / np.var(x / kk - y, ddof=1), rel_tol=1e-7)
        assert math.isclose(got[k].i_hat * got[k].k_hat, np.corrcoef(x, y)[0, 1] ** 2, rel_tol=1e-9)
    assert got[10].i_hat is None and got[10].spearman is None
    assert got[11].k_hat is None and got[11].snr is None
    assert (got[12].i_hat, got[12].var_star, got[12].spearman, got[12].mse, got[12].n) == (None, None, None, 4.0, 1)
    assert got[13].k_hat == 0.5 and got[13].snr == math.inf


def test_jackknife(frame):
    rows, df = frame
    got = {r.k: r for r in st.jackknife(df, ["k"], "i", "x", "y").collect()}
    for k in (*range(6), 13):
        x, y = (np.array([r[j] for r in rows if r[0] == k]) for j in (2, 3))
        full = st.slope_of(x, y)
        each = np.array([st.slope_of(np.delete(x, i), np.delete(y, i)) for i in range(len(x))])
        assert math.isclose(got[k].slope, full, rel_tol=1e-9)
        assert np.allclose([got[k].least, got[k].most, got[k].spread], [each.min(), each.max(), each.std(ddof=1)], atol=1e-9)
        if k < 6:
            assert got[k].item == int(np.abs(each - full).argmax())
    assert got[10].slope is None and got[10].item == 0 and got[10].change is None
    assert got[12].slope is None and got[12].n == 1


def test_bootstrap_is_exact_and_seeded(frame):
    rows, df = frame
    got = {r.k: r for r in st.bootstrap(df, "k", "i", "x", "y", samples=50, seed=9).collect()}
    x, y = (np.array([r[j] for r in rows if r[0] == 2]) for j in (2, 3))
    rng = np.random.default_rng(9)
    draws = [st.slope_of(x[s], y[s]) for s in (rng.integers(0, 12, size=12) for _ in range(50))]
    assert np.allclose([got[2].low, got[2].high], np.nanquantile(draws, [0.025, 0.975]))
    assert got[10].point is None and got[10].low is None and got[12].low is None


def test_p_values(spark):
    assert math.isclose(st.correlation_p(0.5, 10), 0.14111328125, abs_tol=1e-12)
    assert math.isclose(st.correlation_p(0.9, 5), 0.0373860734685, abs_tol=1e-10)
    assert math.isclose(st.correlation_p(-0.5, 10), st.correlation_p(0.5, 10))
    assert st.correlation_p(1.0, 5) == 0.0 and st.correlation_p(None, 9) is None and st.correlation_p(0.3, 2) is None
    assert math.isclose(st.fisher_p(math.log(0.05), 1), 0.05, rel_tol=1e-12)
    t = 0.05 * 0.1
    assert math.isclose(st.fisher_p(math.log(t), 2), t * (1 - math.log(t)), rel_tol=1e-12)
    assert st.fisher_p(-1e9, 3) == np.finfo(float).tiny
    df = spark.createDataFrame([(0.1, 0.05), (None, None), (0.3, 0.1)], "s double, p double")
    r = st.combined(df, "s", "p").first()
    assert math.isclose(r.average, 0.2) and (r.n_valid, r.n_all) == (2, 3)
    assert st.combined(df.limit(0), "s", "p").first().fisher_pvalue is None


def test_summary_of_nothing(spark):
    r = st.summary(spark.createDataFrame([], "v double"), "v").first()
    assert r.n == 0 and r.mean is None and r.median is None


def test_rank_correlation_skips_what_is_not_finite(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (1, math.nan, 2.0), (1, 2.0, math.inf), (1, 3.0, 5.0), (1, None, 1.0), (1, 2.0, 0.0)], "k int, x double, y double")
    r = st.rank_correlation(df, ["k"], "x", "y").first()
    assert r.n == 3 and math.isclose(r.spearman, 0.5)
