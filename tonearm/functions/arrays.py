"""Arrays of numbers as vectors, masks and signals: higher-order functions only, no Python in the rows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once a row: what a lambda takes from outside is computed again for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def doubles(v: Column | str) -> Column:
    """The array as double, so that sums keep their digits."""
    return _c(v).cast("array<double>")


def total(v: Column | str) -> Column:
    """The sum of an array of doubles; 0 for an empty one."""
    return F.aggregate(doubles(v), F.lit(0.0), lambda a, x: a + x)


def dot(a: Column | str, b: Column | str) -> Column:
    """The inner product of two arrays of equal length."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str, p: float = 2.0) -> Column:
    """The 1-, 2- or infinity-norm."""
    if p == 1.0:
        return F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + F.abs(x))
    if p == math.inf:
        return F.coalesce(F.array_max(F.transform(doubles(v), F.abs)), F.lit(0.0))
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column | str, rule: str = "floor") -> Column:
    """The vector divided by its norm. rule: floor the norm at 1e-12, add 1e-8 to it, or leave a zero vector as it is."""
    n = norm(v)
    by = {"floor": F.greatest(n, F.lit(EPS)), "add": n + 1e-8, "leave": F.when(n > 0, n).otherwise(1.0)}[rule]
    return let(by, lambda b: F.transform(doubles(v), lambda x: x / b))


def cosine(a: Column | str, b: Column | str) -> Column:
    """The cosine of two vectors; 0 if one is zero."""
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(EPS))


def mean(v: Column | str) -> Column:
    """The mean of an array; null for an empty one."""
    return F.try_divide(total(v), F.size(_c(v)))


def mean_square(v: Column | str, target: Column | str | None = None) -> Column:
    """The mean squared value, or difference to a target."""
    d = doubles(v) if target is None else F.zip_with(doubles(v), doubles(target), lambda x, y: x - y)
    return F.try_divide(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x), F.size(_c(v)))


def mean_abs(v: Column | str, target: Column | str) -> Column:
    """The mean absolute difference to a target."""
    d = F.zip_with(doubles(v), doubles(target), lambda x, y: F.abs(x - y))
    return F.try_divide(total(d), F.size(_c(v)))


def peak_db(v: Column | str) -> Column:
    """20 log10 of the largest magnitude; minus infinity for silence."""
    top = F.array_max(F.transform(doubles(v), F.abs))
    return F.when(top > 0, 20 * F.log10(top)).otherwise(float("-inf"))


def is_silent(v: Column | str, threshold_db: float = -60.0) -> Column:
    """Whether nothing is louder than the threshold."""
    return peak_db(v) < threshold_db


def silence_ratio(v: Column | str, threshold: float = 0.01) -> Column:
    """The share of samples under the threshold."""
    quiet = F.size(F.filter(doubles(v), lambda x: F.abs(x) < threshold))
    return F.try_divide(quiet, F.size(_c(v)))


def any_channel_silent(channels: Column | str, threshold: float = 0.01, most: float = 0.3) -> Column:
    """Whether a channel of an array of channels has a larger share of silence than most."""
    return F.exists(_c(channels), lambda ch: silence_ratio(ch, threshold) > most)


def power_to_db(v: Column | str, floor: float = 1e-10, span: float = 80.0) -> Column:
    """Powers in dB, floored, and no lower than span under the largest."""
    db = F.transform(doubles(v), lambda x: 10 * F.log10(F.greatest(x, F.lit(floor))))
    return let(db, lambda d: let(F.array_max(d) - span, lambda low: F.transform(d, lambda x: F.greatest(x, low))))


def pad_crop(v: Column | str, size: int, start: Column | int = 0) -> Column:
    """size values from start, with zeros behind if there are fewer."""
    part = F.slice(doubles(v), F.lit(1) + start, F.lit(size))
    return F.concat(part, F.array_repeat(F.lit(0.0), F.greatest(F.lit(size) - F.size(part), F.lit(0))))


def pad_mask(v: Column | str, size: int) -> Column:
    """1 where pad_crop() has values, 0 where it has padding."""
    n = F.least(F.size(_c(v)), F.lit(size))
    return F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(size) - n))


def resize_nearest(mask: Column | str, size: Column | int) -> Column:
    """The array at size places, each with the value at the place scaled down to a whole number."""
    m = F.lit(size) if isinstance(size, int) else size
    n = F.size(_c(mask))
    return F.when(m > 0, F.transform(F.sequence(F.lit(0), m - 1), lambda i: F.get(_c(mask), F.floor(i * n / m).cast("int")))).otherwise(
        F.slice(_c(mask), 1, 0)
    )


def last_set(mask: Column | str) -> Column:
    """The index (from 0) of the last 1 of a mask; -1 if there is none."""
    p = F.array_position(F.reverse(_c(mask)), 1)
    return F.when(p > 0, F.size(_c(mask)) - p).otherwise(-1)


def centred_clip(v: Column | str, size: int) -> Column:
    """size values around the middle, with zeros behind if there are fewer."""
    n = F.size(_c(v))
    start = F.floor(F.greatest(n - size, F.lit(0)) / 2).cast("int")
    return pad_crop(v, size, start)


def fold_patches(v: Column | str, size: int) -> Column:
    """An array of size rows: row h holds the values h, h + size, ... after padding with zeros to a multiple of size."""
    n = F.size(_c(v))
    whole = F.ceil(n / F.lit(size)).cast("int") * size
    padded = F.concat(doubles(v), F.array_repeat(F.lit(0.0), whole - n))
    rows = F.sequence(F.lit(0), F.lit(size - 1))
    cols = F.when(whole > 0, F.sequence(F.lit(0), F.greatest((whole / size).cast("int") - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return let(padded, lambda p: F.transform(rows, lambda h: F.transform(cols, lambda i: F.get(p, i * size + h))))


def unfold_patches(rows: Column | str) -> Column:
    """The values of fold_patches(), padding included."""
    n = F.size(F.get(_c(rows), 0))
    cols = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(cols, lambda i: F.transform(_c(rows), lambda row: F.get(row, i))))


def digits_to_index(digits: Column | str, levels: list[int]) -> Column:
    """The number of a code in mixed radix, lowest digit first."""
    out, base = F.lit(0).cast("bigint"), 1
    for i, level in enumerate(levels):
        out = out + F.get(_c(digits), i).cast("bigint") * base
        base *= level
    return out


def index_to_digits(index: Column | str, levels: list[int]) -> Column:
    """The digits of digits_to_index()."""
    out, base = [], 1
    for level in levels:
        out.append(F.pmod(F.floor(_c(index) / F.lit(base)), F.lit(level)).cast("int"))
        base *= level
    return F.array(*out)


def soft_mask(size: int, start_pct, end_pct, soft_left_pct, soft_right_pct, keep: Column | float = 0.0) -> Column:
    """1 between two places with half Hann windows at both ends, 0 elsewhere, all times 1 - keep; places in percent of size."""
    pct = [_c(p) if not isinstance(p, (int, float)) else F.lit(float(p)) for p in (start_pct, end_pct, soft_left_pct, soft_right_pct)]
    a, b = F.floor(pct[0] / 100 * size), F.ceil(pct[1] / 100 * size)
    left, right = F.bround(pct[2] / 100 * size), F.bround(pct[3] / 100 * size)

    def hann(i: Column, n: Column) -> Column:
        return 0.5 - 0.5 * F.cos(F.lit(2 * math.pi) * i / F.greatest(2 * n - 1, F.lit(1)))

    def value(i: Column) -> Column:
        ends = F.when((i >= b - right) & (i < b), hann(i - (b - right) + right, right))
        ends = ends.when((i >= a) & (i < a + left), hann(i - a, left))
        return ends.when((i >= a) & (i < b), 1.0).otherwise(0.0) * (1 - (F.lit(keep) if isinstance(keep, float) else keep))

    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), value)


def adapt_channels(channels: Column | str, target: int) -> Column:
    """An array of channels brought to target channels: mean for one, repeated from one, trimmed, or tiled with the rest."""
    c, n = _c(channels), F.size(_c(channels))
    cols = F.sequence(F.lit(0), F.greatest(F.size(F.get(c, 0)) - 1, F.lit(0)))
    mono = let(c, lambda held: F.array(F.transform(cols, lambda i: mean(F.transform(held, lambda ch: F.get(ch, i))))))
    tiled = let(c, lambda held: F.transform(F.sequence(F.lit(0), F.lit(target - 1)), lambda k: F.get(held, F.pmod(k, n).cast("int"))))
    return F.when(n == target, c).otherwise(mono if target == 1 else tiled)


def stereo(channels: Column | str) -> Column:
    """Two channels: one is doubled, more are cut."""
    c = _c(channels)
    return F.when(F.size(c) == 1, F.concat(c, c)).otherwise(F.slice(c, 1, 2))


def binary_mask_at(mask: Column | str, step: Column | int, steps: int) -> Column:
    """1 where a soft mask is at most (step + 1) / steps."""
    s = F.lit(step) if isinstance(step, int) else step
    return F.transform(_c(mask), lambda m: F.when(m <= (s + 1) / F.lit(float(steps)), 1).otherwise(0))


def split_by_prefix(m: Column | str, prefix: str, keep_prefix: bool = False) -> tuple[Column, Column]:
    """(entries whose key has the prefix, the others) of a map; the prefix is cut off unless it is kept."""
    own = F.map_filter(_c(m), lambda k, _: F.startswith(k, F.lit(prefix)))
    if not keep_prefix:
        own = F.transform_keys(own, lambda k, _: F.substr(k, F.lit(len(prefix) + 1)))
    return own, F.map_filter(_c(m), lambda k, _: ~F.startswith(k, F.lit(prefix)))


def masked_mean(d: Column, mask: Column | str | None) -> Column:
    """The mean of an array where mask is true, of all of it where the mask is null."""
    if mask is None:
        return mean(d)
    m = _c(mask)
    kept = F.transform(F.filter(F.arrays_zip(d.alias("d"), m.alias("m")), lambda p: p["m"]), lambda p: p["d"])
    return F.when(m.isNull(), mean(d)).otherwise(mean(kept))


def masked_l1(a: Column | str, b: Column | str, mask: Column | str | None = None) -> Column:
    """The mean absolute difference where mask is true."""
    return masked_mean(F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y)), mask)


def masked_mse(a: Column | str, b: Column | str, mask: Column | str | None = None) -> Column:
    """The mean squared difference where mask is true."""
    return masked_mean(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), mask)


def image_loss(a: Column | str, b: Column | str) -> Column:
    """Half of 1 minus the cosine."""
    return 0.5 * (1 - cosine(a, b))


def distortion_ratio(estimate: Column | str, target: Column | str, zero_mean: bool = True, scaled: bool = True, eps: float = 1e-8) -> Column:
    """The negative signal-to-distortion ratio in dB, scale-invariant (scaled) or scale-dependent."""
    def centred(v: Column) -> Column:
        return let(mean(v), lambda m: F.transform(v, lambda e: e - m)) if zero_mean else v

    def ratio(x: Column, t: Column) -> Column:
        def from_fit(fitted: Column) -> Column:
            rest = F.zip_with(x, fitted if scaled else t, lambda a, b: a - b)
            return -10 * F.log10(dot(fitted, fitted) / (dot(rest, rest) + eps) + eps)

        return let(let(dot(x, t) / (dot(t, t) + eps), lambda k: F.transform(t, lambda v: v * k)), from_fit)

    return let(centred(doubles(estimate)), lambda x: let(centred(doubles(target)), lambda t: ratio(x, t)))


def gaussian_kl(mean_v: Column | str, scale_v: Column | str) -> Column:
    """The sum of mean^2 + var - log var - 1 over a vector, with the standard deviation softplus(scale) + 1e-4."""

    def term(m: Column, s: Column) -> Column:
        sd = F.log1p(F.exp(-F.abs(s))) + F.greatest(s, F.lit(0.0)) + 1e-4
        return m * m + sd * sd - 2 * F.log(sd) - 1

    return total(F.zip_with(doubles(mean_v), doubles(scale_v), term))


def log_sum_exp(v: Column | str) -> Column:
    """log of the sum of exponentials, without overflow."""
    return let(F.array_max(doubles(v)), lambda top: top + F.log(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + F.exp(x - top))))


def cross_entropy(logits: Column | str, target: Column | str) -> Column:
    """The negative log probability of the target's place (from 0)."""
    return log_sum_exp(logits) - F.get(doubles(logits), _c(target).cast("int"))


def code_matrix(codes: Column | str, deep: bool = False) -> Column:
    """Codes as [book][frame]: of three levels (deep) one of size 1 is dropped, the outermost such one, or the first matrix is
    taken; a matrix with more rows than columns is turned.
    """
    c = _c(codes)
    if deep:
        inner = F.get(c, 0)
        c = (
            F.when(F.size(c) == 1, inner)
            .when(F.size(inner) == 1, F.transform(c, lambda m: F.get(m, 0)))
            .when(F.size(F.get(inner, 0)) == 1, F.transform(c, lambda m: F.transform(m, lambda r: F.get(r, 0))))
            .otherwise(inner)
        )

    def turned(m: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(F.get(m, 0)) - 1, F.lit(0)))
        return F.when(F.size(m) > F.size(F.get(m, 0)), F.transform(at, lambda j: F.transform(m, lambda r: F.get(r, j)))).otherwise(m)

    return let(c, turned)
