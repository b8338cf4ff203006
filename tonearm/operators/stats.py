"""Statistics of paired scores: slopes, rank correlations, signal-to-noise, jackknife, bootstrap and p-values.

An undefined statistic is null, never NaN, and no constant column raises. Groups are the pairs of one contributor, or of
one query; what needs all pairs of a group at once (ranks, resampling) says so.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonearm.operators.skew import join_unique, number_rows


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_finite(c: Column | str) -> Column:
    """Neither null, nor NaN, nor infinite."""
    x = _c(c)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def pearson(x: Column | str, y: Column | str) -> Column:
    """The correlation of the rows where both are given; null for constant columns."""
    both = _c(x).isNotNull() & _c(y).isNotNull()
    a, b = F.when(both, _c(x)), F.when(both, _c(y))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def slope(x: Column | str, y: Column | str) -> Column:
    """The least-squares slope of y on x; null for one row or a constant x."""
    return F.regr_slope(_c(y), _c(x))


def intercept(x: Column | str, y: Column | str) -> Column:
    """The least-squares intercept of y on x."""
    return F.regr_intercept(_c(y), _c(x))


def mean_squared_error(x: Column | str, y: Column | str) -> Column:
    """The mean squared difference."""
    d = _c(x) - _c(y)
    return F.avg(d * d)


def percentiles(df: DataFrame, value: str, cuts: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, p): exact percentiles of a column by key, with linear interpolation, as an array of doubles in the order of cuts;
    a key without values has no row.

    The rows are numbered by range partitions and offsets, and only those next to a cut go on, so that no task needs all the
    values of a key.
    """
    own = [*keys] or ["__all"]
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    rows = number_rows(rows if keys else rows.withColumn("__all", F.lit(0)), own, ["__v"], "__no")
    sizes = rows.groupBy(*own).agg(F.max("__no").alias("__n"))
    places = [F.lit(float(c)) * (F.col("__n") - 1) for c in cuts]
    wanted = F.array_distinct(F.array(*(F.floor(p) for p in places), *(F.ceil(p) for p in places)))
    wanted = sizes.select(*(F.col(k).alias(f"__key{i}") for i, k in enumerate(own)), "__n", F.explode(wanted).alias("__at"))
    near = rows.join(wanted, _same(own) & (F.col("__no") - 1 == F.col("__at")))  # a row at most for each key and number
    got = near.groupBy(*own).agg(F.map_from_entries(F.collect_list(F.struct("__at", "__v"))).alias("__m"), F.max("__n").alias("__n"))

    def between(p: Column) -> Column:
        low, high = F.element_at("__m", F.floor(p)), F.element_at("__m", F.ceil(p))
        return low + (high - low) * (p - F.floor(p))

    return got.select(*keys, F.array(*(between(p) for p in places)).alias("p"))


def _same(keys: Sequence[str], prefix: str = "__key") -> Column:
    """The condition that keys equal the columns of another table that stand for them, nulls too."""
    out = F.lit(True)
    for i, k in enumerate(keys):
        out = out & F.col(k).eqNullSafe(F.col(f"{prefix}{i}"))
    return out


def with_average_rank(df: DataFrame, value: str, keys: Sequence[str], name: str, descending: bool = False, groups_fit: bool = False) -> DataFrame:
    """df with the rank of value within keys, from 1; equal values share the mean of their ranks.

    groups_fit: all rows of a key fit into a task, as the queries of one contributor do; a window ranks them. Otherwise the rows
    are numbered by range partitions and offsets, and equal values take the mean of their first and last number.
    """
    order = F.col(value).desc() if descending else F.col(value).asc()
    if groups_fit:
        place = F.rank().over(Window.partitionBy(*keys).orderBy(order))
        ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
        return df.withColumn(name, place + (ties - 1) / 2.0)
    rows = number_rows(df, keys, [order], "__no")
    by = [*keys, value]
    ranks = rows.groupBy(*by).agg(((F.min("__no") + F.max("__no")) / 2.0).alias(name))
    return join_unique(rows, ranks, by, "inner", null_safe=True).select(*df.columns, name)


def rank_correlation(df: DataFrame, keys: Sequence[str], x: str, y: str, name: str = "spearman", groups_fit: bool = False) -> DataFrame:
    """(keys, name, n) by key over the rows where both values are finite; groups_fit as in with_average_rank()."""
    ok = df.where(is_finite(x) & is_finite(y)).select(*keys, F.col(x).alias("__x"), F.col(y).alias("__y"))
    ranked = with_average_rank(ok, "__x", keys, "__rx", groups_fit=groups_fit)
    ranked = with_average_rank(ranked, "__y", keys, "__ry", groups_fit=groups_fit)
    return ranked.groupBy(*keys).agg(pearson("__rx", "__ry").alias(name), F.count(F.lit(1)).alias("n"))


def estimates(df: DataFrame, keys: Sequence[str], hat: str, star: str) -> DataFrame:
    """Per key: i_hat (slope of star on hat), k_hat (slope of hat on star), spearman, snr (calibrated), snr_shortcut,
    var_star, mse and n. One row of a key leaves the slopes, the variance and the correlation null; mse is defined.
    """
    from tonearm.functions.scalar import snr_from_slope

    rows = df.select(*keys, F.col(hat).cast("double").alias("__h"), F.col(star).cast("double").alias("__s"))
    first = rows.groupBy(*keys).agg(
        slope("__h", "__s").alias("i_hat"),
        slope("__s", "__h").alias("k_hat"),
        F.var_samp("__s").alias("var_star"),
        F.var_samp("__h").alias("__vh"),
        F.covar_samp("__h", "__s").alias("__c"),
        mean_squared_error("__h", "__s").alias("mse"),
        F.count(F.lit(1)).alias("n"),
    )
    ranks = rank_correlation(rows, keys, "__h", "__s", groups_fit=True).select(*keys, "spearman")
    out = first.join(ranks, list(keys), "left")
    # The variance of hat / k - star, from the centred sums of the same pass.
    k = F.when(F.abs("k_hat") >= 1e-12, F.col("k_hat"))
    noise = F.try_divide(F.col("__vh"), k * k) - 2 * F.try_divide(F.col("__c"), k) + F.col("var_star")
    snr = F.when(noise <= 0, float("inf")).otherwise(F.try_divide("var_star", noise))
    return out.select(
        *keys, "i_hat", "k_hat", "spearman", snr.alias("snr"), snr_from_slope("i_hat").alias("snr_shortcut"), "var_star", "mse", "n"
    )


def jackknife(df: DataFrame, keys: Sequence[str], item: str, x: str, y: str) -> DataFrame:
    """Per key the slope of y on x over all items, and the least, the largest and the spread of the slopes without one item,
    the item whose absence changes it most, and the change. The first item stands where no change is defined.

    The slopes without an item follow from the key's sums, centred on its means; means, sums and result need one shuffle by
    key. A key's items, which are as many as queries, are read by one task.
    """
    w = Window.partitionBy(*keys)
    rows = df.select(*keys, F.col(item).alias("__i"), F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    c = rows.withColumns(
        {"__u": F.col("__x") - F.avg("__x").over(w), "__v": F.col("__y") - F.avg("__y").over(w), "__n": F.count(F.lit(1)).over(w), "__full": slope("__x", "__y").over(w)}
    )
    c = c.withColumns({"__uu": F.sum(F.col("__u") * F.col("__u")).over(w), "__uv": F.sum(F.col("__u") * F.col("__v")).over(w)})
    share = F.try_divide(F.col("__n"), F.col("__n") - 1)
    left_uu = F.col("__uu") - F.col("__u") * F.col("__u") * share
    left_uv = F.col("__uv") - F.col("__u") * F.col("__v") * share
    without = F.when((F.col("__n") > 2) & (left_uu > F.col("__uu") * 1e-14), F.try_divide(left_uv, left_uu))
    c = c.withColumn("__w", without).withColumn("__d", F.col("__w") - F.col("__full"))
    most = F.when(F.col("__d").isNotNull(), F.struct((-F.abs("__d")).alias("a"), F.col("__i").alias("i"), F.col("__d").alias("d")))
    out = c.groupBy(*keys).agg(
        F.max("__full").alias("slope"),
        F.min("__w").alias("least"),
        F.max("__w").alias("most"),
        F.stddev_samp("__w").alias("spread"),
        F.min(most).alias("__hit"),
        F.min("__i").alias("__first"),
        F.count(F.lit(1)).alias("n"),
    )
    return out.select(*keys, "slope", "least", "most", "spread", F.coalesce("__hit.i", "__first").alias("item"), F.col("__hit.d").alias("change"), "n")


Statistic = Callable[[np.ndarray, np.ndarray], float]


def _slopes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    u, v = x - x.mean(1, keepdims=True), y - y.mean(1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = (u * u).sum(1)
        return np.where(spread > 0, (u * v).sum(1) / spread, np.nan)


def _average_ranks(a: np.ndarray) -> np.ndarray:
    """The rank of each value in its row, from 1; equal values share the mean of their ranks."""
    order = np.argsort(a, axis=1, kind="stable")
    s = np.take_along_axis(a, order, 1)
    at = np.broadcast_to(np.arange(a.shape[1]), a.shape)
    new = np.ones(a.shape, bool)
    new[:, 1:] = s[:, 1:] != s[:, :-1]
    end = np.ones(a.shape, bool)
    end[:, :-1] = new[:, 1:]
    first = np.maximum.accumulate(np.where(new, at, 0), axis=1)
    last = np.minimum.accumulate(np.where(end, at, a.shape[1])[:, ::-1], axis=1)[:, ::-1]
    out = np.empty(a.shape)
    np.put_along_axis(out, order, (first + last) / 2.0 + 1, 1)
    return out


def _rank_correlations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    u, v = _average_ranks(x), _average_ranks(y)
    u, v = u - u.mean(1, keepdims=True), v - v.mean(1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        size = np.sqrt((u * u).sum(1) * (v * v).sum(1))
        return np.where(size > 0, (u * v).sum(1) / size, np.nan)


def slope_of(x: np.ndarray, y: np.ndarray) -> float:
    """The slope of y on x; NaN where undefined."""
    return float(_slopes(x[None], y[None])[0]) if len(x) > 1 else math.nan


def rank_correlation_of(x: np.ndarray, y: np.ndarray) -> float:
    """The rank correlation; NaN where undefined."""
    return float(_rank_correlations(x[None], y[None])[0]) if len(x) > 1 else math.nan


#: Pairs that are drawn at a time, and statistics that take many resamples at once, as rows of two matrices.
HELD_DRAWS = 1 << 20
ROWWISE = {slope_of: _slopes, rank_correlation_of: _rank_correlations}


def bootstrap(
    df: DataFrame, key: str, order: str, x: str, y: str, statistic: Statistic = slope_of, samples: int = 1000, level: float = 0.95, seed: int = 42
) -> DataFrame:
    """(key, point, low, high): percentile intervals of a paired statistic, resampled within each key in the order given.

    A key's pairs are read by one task, as resampling needs them all; they are as many as there are queries. Null where the
    point isn't defined. statistic: any function of two arrays.
    """
    at_once = ROWWISE.get(statistic)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("o", kind="stable")
        a, b = pdf["x"].to_numpy(float), pdf["y"].to_numpy(float)
        point = statistic(a, b) if len(a) else math.nan
        low = high = None
        if len(a) > 1 and np.isfinite(point):
            rng = np.random.default_rng(seed)
            got, step = [], max(1, HELD_DRAWS // len(a))
            for first in range(0, samples, step):
                draws = np.stack([rng.integers(0, len(a), size=len(a)) for _ in range(min(step, samples - first))])
                got.append(at_once(a[draws], b[draws]) if at_once is not None else np.array([statistic(a[i], b[i]) for i in draws]))
            got = np.concatenate(got)
            if np.isfinite(got).any():
                low, high = np.nanquantile(got, [(1 - level) / 2, 1 - (1 - level) / 2])
        return pd.DataFrame({"k": [pdf["k"].iloc[0]], "point": [point if np.isfinite(point) else None], "low": [low], "high": [high]})

    rows = df.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    kind = dict(rows.dtypes)["k"]
    out = rows.groupBy("k").applyInPandas(run, f"k {kind}, point double, low double, high double")
    return out.withColumnRenamed("k", key)


def beta_tail(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_tail(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    total = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or tiny)
            c = 1 + top / c or tiny
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * total


def correlation_p(r: float | None, n: int) -> float | None:
    """The two-sided p-value of a correlation of n pairs by Student's distribution; null under 3 pairs."""
    if r is None or n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    free = n - 2
    return beta_tail(free / 2, 0.5, free / (free + r * r * free / (1 - r * r)))


def with_correlation_p(df: DataFrame, r: str, n: str, name: str = "pvalue") -> DataFrame:
    """df with the p-value of each correlation."""

    @F.pandas_udf("double")
    def p(rs: pd.Series, ns: pd.Series) -> pd.Series:
        return pd.Series([correlation_p(None if pd.isna(a) else float(a), int(b)) for a, b in zip(rs, ns)], dtype="float64")

    return df.withColumn(name, p(F.col(r), F.col(n)))


def fisher_p(sum_log: float, count: int) -> float | None:
    """Fisher's combined p-value, from the sum of logs of count p-values; null for none."""
    if not count:
        return None
    half = -sum_log
    log_terms = [0.0]
    for i in range(1, count):
        log_terms.append(log_terms[-1] + math.log(half / i) if half > 0 else -math.inf)
    top = max(log_terms)
    total = math.exp(top - half) * sum(math.exp(t - top) for t in log_terms)
    return max(min(total, 1.0), float(np.finfo(float).tiny))


def combined(df: DataFrame, statistic: str, pvalue: str) -> DataFrame:
    """One row: average statistic, Fisher's p-value, valid and all rows; p-values are floored at the smallest normal double."""
    tiny = float(np.finfo(float).tiny)
    ok = F.col(statistic).isNotNull() & F.col(pvalue).isNotNull()
    row = df.agg(
        F.avg(F.when(ok, F.col(statistic))).alias("average"),
        F.sum(F.when(ok, F.log(F.greatest(F.col(pvalue), F.lit(tiny))))).alias("logs"),
        F.count(F.when(ok, 1)).alias("valid"),
        F.count(F.lit(1)).alias("all"),
    ).first()
    p = fisher_p(row.logs or 0.0, row.valid)
    schema = "average double, fisher_pvalue double, n_valid bigint, n_all bigint"
    return df.sparkSession.createDataFrame([(row.average, p, row.valid, row["all"])], schema)


def summary(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """count, mean, population deviation, least, quartiles and largest of a column, by keys; null statistics for no values."""
    v = F.col(value)
    base = df.groupBy(*keys).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("least"), F.max(v).alias("most")
    )
    named = percentiles(df, value, [0.25, 0.5, 0.75], keys)
    named = named.select(*(F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)), *(F.get("p", i).alias(c) for i, c in enumerate(("p25", "median", "p75"))))
    out = base.join(named, _same(keys), "left") if keys else base.withColumn("__one", F.lit(1)).join(F.broadcast(named.withColumn("__one", F.lit(1))), "__one", "left")
    return out.select(*keys, "n", "mean", "std", "least", "p25", "median", "p75", "most")
