"""Keyed random draws: masks, timesteps and noise that depend on seed and key only, so that any re-run gives the same."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tonearm.functions.arrays import let
from tonearm.functions.scalar import draw


def normal(seed: int, *keys: Column) -> Column:
    """A standard normal draw by the Box-Muller transform of two keyed draws."""
    u = F.greatest(draw(seed, *keys), F.lit(1e-12))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * draw(seed + 7919, *keys))


def logsnr_time(seed: int, key: Column, mean: float = -1.2, std: float = 2.0) -> Column:
    """The time whose log signal-to-noise ratio is a normal draw, within [1e-4, 1 - 1e-4]."""
    t = 1 / (1 + F.exp(normal(seed, key) * std + mean))
    return F.least(F.greatest(t, F.lit(1e-4)), F.lit(1 - 1e-4))


# The coefficients of a published rational approximation of the inverse normal distribution (relative error 1.2e-9).
_MIDDLE = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
_MIDDLE_UNDER = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
_TAIL = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
_TAIL_UNDER = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)


def _polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_quantile(p: Column) -> Column:
    """The value under which a standard normal draw lies with probability p; null outside (0, 1)."""
    r = (p - 0.5) * (p - 0.5)
    middle = (p - 0.5) * _polynomial(r, _MIDDLE) / _polynomial(r, _MIDDLE_UNDER)
    tail = lambda q: _polynomial(q, _TAIL) / _polynomial(q, _TAIL_UNDER)
    low, high = F.sqrt(-2 * F.log(p)), F.sqrt(-2 * F.log(1 - p))
    return F.when((p > 0) & (p < 0.02425), tail(low)).when((p <= 1 - 0.02425) & (p > 0), middle).when((p > 0) & (p < 1), -tail(high))


def normal_distribution(z: Column) -> Column:
    """The probability that a standard normal draw is at most z, by an alternating series in the middle and a continued
    fraction in the tails; to about 1e-9.
    """
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)),
        F.struct(z.alias("t"), z.alias("s")),
        lambda acc, i: F.struct((acc["t"] * z * z / (2 * i + 1)).alias("t"), (acc["s"] + acc["t"] * z * z / (2 * i + 1)).alias("s")),
    )
    density = F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), F.abs(z), lambda acc, i: F.abs(z) + i / acc)
    tail = density / fraction
    return F.when(F.abs(z) < 5, 0.5 + density * terms["s"]).when(z > 0, 1 - tail).otherwise(tail)


def bound_of(t: float) -> float:
    """The share of logistic-normal draws below t."""
    return 0.0 if t <= 0 else 1.0 if t >= 1 else 0.5 * math.erfc(-math.log(t / (1 - t)) / math.sqrt(2))


def truncated_time(seed: int, key: Column, left: float = 0.075, right: float = 1.0) -> Column:
    """A logistic-normal draw truncated to [left, right] and scaled to [0, 1]."""
    low, high = bound_of(left), bound_of(right)
    u = F.lit(low) + (high - low) * draw(seed, key)
    z = normal_quantile(F.greatest(u, F.lit(1e-300)))
    return (1 / (1 + F.exp(-z)) - left) / (right - left)


def inpaint_mask(key: Column, size: Column, real: Column, seed: int = 0, weights: tuple[float, float, float] = (0.1, 0.8, 0.1), segments: int = 10) -> Column:
    """1 to keep, 0 to inpaint: random segments of the real part, everything, or what follows a random prefix of it."""
    whole = sum(weights)
    kind = draw(seed, key) * whole
    at = F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)))
    count = 1 + F.floor(draw(seed + 1, key) * segments).cast("int")
    longest = F.greatest(F.lit(1), F.floor(real / count).cast("int"))

    def segment(i: Column) -> Column:
        n = 1 + F.floor(draw(seed + 2, key, i) * longest).cast("int")
        start = F.floor(draw(seed + 3, key, i) * (F.greatest(real - n, F.lit(0)) + 1)).cast("int")
        return F.struct(start.alias("a"), (start + n).alias("b"), (n <= real).alias("ok"))

    cuts = F.transform(F.sequence(F.lit(1), count), segment)
    random = let(cuts, lambda held: F.transform(at, lambda p: F.when(F.exists(held, lambda s: s["ok"] & (p >= s["a"]) & (p < s["b"])), 0).otherwise(1)))
    prefix = F.floor(draw(seed + 4, key) * (real + 1)).cast("int")
    causal = let(prefix, lambda first: F.transform(at, lambda p: F.when((p >= first) & (p < real), 0).otherwise(1)))
    ones = F.transform(at, lambda p: F.lit(1))
    full = F.transform(at, lambda p: F.lit(0))
    chosen = F.when((kind >= weights[0]) & (kind < weights[0] + weights[1]), full).when(real == 0, ones).when(kind < weights[0], random).otherwise(causal)
    return F.when(size > 0, chosen).otherwise(F.array().cast("array<int>"))
