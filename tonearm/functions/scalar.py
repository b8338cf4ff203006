"""Scalar functions of catalog, prompt and schedule columns. All take and return columns, and stay in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tonearm.functions.arrays import let
from tonearm.functions.ids import basename, first_number


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trailing_number(c: Column | str) -> Column:
    """The digits at the end of an id as bigint; null if there are none."""
    return F.regexp_extract(_c(c), "([0-9]+)$", 1).try_cast("bigint")


def first_number_of_name(c: Column | str) -> Column:
    """The first run of digits of the last path segment."""
    return first_number(basename(_c(c)))


def last_number_before_extension(c: Column | str) -> Column:
    """The digits that stand right before the extension."""
    return F.regexp_extract(_c(c), r"([0-9]+)(?=\.[^.]+$)", 1).try_cast("bigint")


def clean_tag(c: Column | str) -> Column:
    """Underscores as blanks, blanks collapsed and trimmed; null where nothing is left."""
    t = F.trim(F.regexp_replace(F.translate(_c(c), "_", " "), r"\s+", " "))
    return F.when(t != "", t)


def tag_type(c: Column | str, lower: bool = False) -> Column:
    """What stands before the first '---' of a tag; 'tag' if there is none."""
    t = F.trim(_c(c))
    kind = F.when(F.contains(t, F.lit("---")), F.substring_index(t, "---", 1)).otherwise("tag")
    return F.lower(kind) if lower else kind


def tag_value(c: Column | str) -> Column:
    """What stands after the first '---' of a tag, or the whole tag, cleaned."""
    t = F.trim(_c(c))
    return clean_tag(F.when(F.contains(t, F.lit("---")), F.regexp_replace(t, "^.*?---", "")).otherwise(t))


def tags_by_type(tags: Column | str, lower: bool = False) -> Column:
    """A map from type to the list of cleaned values, from an array of tags; order is kept, empty values are dropped."""
    pairs = F.filter(
        F.transform(_c(tags), lambda t: F.struct(tag_type(t, lower).alias("k"), tag_value(t).alias("v"))), lambda p: p["v"].isNotNull()
    )

    def grouped(held: Column) -> Column:
        kinds = F.array_distinct(F.transform(held, lambda p: p["k"]))
        return F.map_from_arrays(kinds, F.transform(kinds, lambda k: F.transform(F.filter(held, lambda p: p["k"] == k), lambda p: p["v"])))

    return let(pairs, grouped)


def values_of_type(tags: Column | str, kind: str) -> Column:
    """The cleaned values of one type, in order, from an array of tags."""
    own = F.filter(_c(tags), lambda t: tag_type(t) == kind)
    return F.filter(F.transform(own, tag_value), lambda v: v.isNotNull())


def year(c: Column | str) -> Column:
    """What stands before the first '-' of a date string."""
    return F.substring_index(_c(c), "-", 1)


def padded(prefix: str, c: Column | str, width: int) -> Column:
    """prefix and a number with leading zeros."""
    return F.format_string(f"{prefix}%0{width}d", _c(c).cast("bigint"))


def shard_path(c: Column | str, ending: str = ".mp3") -> Column:
    """Two digits of the number's remainder by 100 as folder, then the number."""
    n = _c(c).cast("bigint")
    return F.format_string(f"%02d/%d{ending}", F.pmod(n, F.lit(100)), n)


def token_count(c: Column | str) -> Column:
    """Tokens between blanks; 0 for blank, null for null."""
    t = F.trim(F.regexp_replace(_c(c), r"\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def labelled_prompt(title, artist, album, released, genre, moods, instruments, fallback) -> Column:
    """'title: .., artist: .., album: .., year: .., genre: .., mood: .., instrument: ..' of what is there, with at most three
    moods and instruments and without an unknown genre; the fallback if nothing is there.
    """

    def part(label: str, v: Column) -> Column:
        return F.when(v.isNotNull() & (v != ""), F.concat(F.lit(f"{label}: "), v))

    def few(label: str, v: Column) -> Column:
        joined = F.array_join(F.slice(v, 1, 3), ", ")
        return F.when(F.size(v) > 0, F.concat(F.lit(f"{label}: "), joined))

    known = F.when(_c(genre) != "unknown", _c(genre))
    pieces = [
        part("title", _c(title)),
        part("artist", _c(artist)),
        part("album", _c(album)),
        part("year", _c(released)),
        part("genre", known),
        few("mood", _c(moods)),
        few("instrument", _c(instruments)),
    ]
    text = F.concat_ws(", ", *pieces)
    return F.when(text != "", text).otherwise(_c(fallback))


def shuffled(seed: int, *keys: Column | str) -> Column:
    """Text whose order is a random one that depends on the seed and the keys only; any engine with MD5 gets the same."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(_c(k).cast("string") for k in keys)))


def draw(seed: int, *keys: Column | str) -> Column:
    """A number in [0, 1) that depends on the seed and the keys only."""
    return F.conv(F.substring(shuffled(seed, *keys), 1, 10), 16, 10).cast("bigint") / float(1 << 40)


def random_prompt(key, fields: dict[str, Column], lists: dict[str, Column], seed: int = 0) -> Column:
    """A prompt of some of the fields in shuffled order: each is kept with probability 0.7 and one at least, lists give one to
    four values, half the prompts carry labels, a fifth of the values is lower and a twentieth upper case. Draws are keyed.
    """
    parts = []
    for i, (label, value) in enumerate([*fields.items(), *lists.items()]):
        many = label in lists
        if many:
            mixed = F.transform(F.array_sort(F.transform(value, lambda v: F.struct(shuffled(seed, key, v).alias("h"), v.alias("v")))), lambda s: s["v"])
            count = 1 + F.floor(draw(seed + 1, key, F.lit(i)) * F.least(F.size(value), F.lit(4))).cast("int")
            few = F.slice(mixed, F.lit(1), F.greatest(F.least(count, F.size(value)), F.lit(0)))
            text, name = F.array_join(few, ", "), F.when(F.size(few) > 1, f"{label}s").otherwise(label)
            there = F.size(value) > 0
        else:
            text, name, there = value, F.lit(label), value.isNotNull() & (value != "")
        roll = draw(seed + 2, key, F.lit(i))
        cased = F.when(roll < 0.2, F.lower(text)).when(roll < 0.25, F.upper(text)).otherwise(text)
        shown = F.when(draw(seed + 3, key) < 0.5, F.concat(name, F.lit(": "), cased)).otherwise(cased)
        parts.append(
            F.struct(
                F.coalesce(there, F.lit(False)).alias("there"),
                (draw(seed + 4, key, F.lit(i)) < 0.7).alias("kept"),
                shuffled(seed + 5, key, F.lit(i)).alias("at"),
                F.coalesce(shown, F.lit("")).alias("text"),
            )
        )
    usable = F.filter(F.array(*parts), lambda p: p["there"])
    kept = F.filter(usable, lambda p: p["kept"])
    chosen = F.when(F.size(kept) > 0, kept).otherwise(F.slice(usable, 1, 1))
    ordered = F.array_sort(F.transform(chosen, lambda p: F.struct(p["at"].alias("at"), p["text"].alias("text"))))
    text = F.array_join(F.transform(ordered, lambda p: p["text"]), ", ")
    return F.when(F.size(usable) > 0, text)


def marginal_gain(snr: Column | str, variance: Column | str, alpha: float = 1.0) -> Column:
    """variance / (2 alpha (1 + snr)^2); 0 for an infinite snr, null where it isn't defined."""
    s = _c(snr)
    value = F.try_divide(_c(variance), F.lit(2.0 * alpha) * (1 + s) * (1 + s))
    return F.when(s == float("inf"), F.when(_c(variance).isNotNull(), 0.0)).otherwise(value)


def snr_from_slope(c: Column | str) -> Column:
    """Infinity from 1 on, 0 up to 0, else x / (1 - x); null for null and not finite."""
    x = _c(c)
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    ratio = F.when((x > 0) & (x < 1), F.try_divide(x, 1 - x))
    return F.when(finite, F.when(x >= 1, float("inf")).when(x <= 0, 0.0).otherwise(ratio))


def min_max(c: Column | str, low: float, high: float) -> Column:
    """The value clamped to [low, high] and scaled to [0, 1]."""
    return (F.least(F.greatest(_c(c), F.lit(low)), F.lit(high)) - low) / (high - low)


def option_index(c: Column | str, options: list[str]) -> Column:
    """The option's place from 1; 0 if it is none of them."""
    return F.coalesce(F.array_position(F.array(*(F.lit(o) for o in options)), _c(c)), F.lit(0))


def clip_unit(v: Column | str) -> Column:
    """Samples clipped to [-1, 1]."""
    return F.transform(_c(v), lambda x: F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0)))


def to_int16(v: Column | str) -> Column:
    """Clipped samples scaled by 32767 and cut to whole numbers."""
    return F.transform(clip_unit(v), lambda x: (x * 32767.0).cast("smallint"))


def peak_normalise(v: Column | str) -> Column:
    """Samples divided by the largest magnitude, if it isn't 0."""
    peak = F.array_max(F.transform(_c(v), F.abs))
    return let(peak, lambda top: F.when(top > 0, F.transform(_c(v), lambda x: x / top)).otherwise(_c(v)))


def cosine_schedule(t: Column | str) -> tuple[Column, Column]:
    """(alpha, sigma) of a time in [0, 1]."""
    angle = _c(t) * (math.pi / 2)
    return F.cos(angle), F.sin(angle)


def schedule_time(alpha: Column | str, sigma: Column | str) -> Column:
    """The time of a pair of cosine_schedule()."""
    return F.atan2(_c(sigma), _c(alpha)) / math.pi * 2


def shifted_time(t, length, base=0.5, most=1.15, min_length=256, max_length=4096, sine=False) -> Column:
    """The time moved by a shift that grows with the length; at t = 1 the limit, 1."""
    n = F.least(F.greatest(_c(length), F.lit(min_length)), F.lit(max_length))
    growth = F.exp(-(F.lit(base) + (most - base) * (n - min_length) / (max_length - min_length)))
    odds = F.try_divide(F.lit(1.0), 1 - _c(t)) - 1
    out = F.when(_c(t) >= 1, 1.0).otherwise(1 - growth / (growth + odds))
    return F.sin(out * (math.pi / 2)) if sine else out


def picked_timesteps(k: Column | str, steps: Column | str, uniform: bool = True) -> Column:
    """k timesteps: evenly strided over the steps, or the first k; an empty list for k < 1."""
    kk, n = _c(k).cast("int"), _c(steps).cast("int")
    stride = F.greatest(F.lit(1), F.floor(n / F.greatest(kk, F.lit(1))).cast("int")) if uniform else F.lit(1)
    last = (n if uniform else kk) - 1
    some = F.slice(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), stride), F.lit(1), F.greatest(kk, F.lit(1)))
    return F.when((kk >= 1) & (last >= 0), some).otherwise(F.array().cast("array<int>"))


def seconds_total(duration: Column | str, most: float) -> Column:
    """The duration, at most most; most for durations that aren't positive; null for null."""
    d = _c(duration)
    return F.when(d.isNull(), None).when((d <= 0) | F.isnan(d), F.lit(most)).otherwise(F.least(d, F.lit(most)))


def crop_times(offset, samples, size: int, rate: int) -> list[Column]:
    """t_start, t_end, seconds_start, seconds_total of a crop of size samples at an offset."""
    o, n = _c(offset), _c(samples)
    whole = F.greatest(n - size, F.lit(0)) + size
    return [
        (o / whole).alias("t_start"),
        ((o + size) / whole).alias("t_end"),
        F.floor(o / rate).alias("seconds_start"),
        F.ceil(n / rate).alias("seconds_total"),
    ]


def inverse_decay(step, base: float, inv_gamma: float = 1.0, power: float = 1.0, warmup: float = 0.0, final: float = 0.0) -> Column:
    """A rate that halves (to the power) every inv_gamma steps, with exponential warm-up, never under final before warm-up."""
    s = _c(step)
    warm = 1 - F.pow(F.lit(warmup), s + 1)
    return warm * F.greatest(F.lit(final), F.lit(base) * F.pow(1 + s / inv_gamma, F.lit(-power)))


def decayed_weight(weight: float, decay: float, calls: Column | str) -> Column:
    """A weight after so many calls that each multiply it by decay."""
    return F.lit(weight) * F.pow(F.lit(decay), _c(calls))
