"""Same or near-same records across splits: an edit-distance segment join over words.

A text is taken as the string of its different words in a canonical order (of their hashes). For two such strings the edit
distance by insertions and deletions is the size of the symmetric difference, so a Jaccard similarity of t means a distance of
at most k = |A| + |B| - 2 ceil(t (|A| + |B|) / (1 + t)). An evaluation string is cut into k + 1 segments; k edits can't touch
all of them, so one stands unchanged in the training string, shifted by no more than k. Candidates that share a segment are
verified by banded dynamic programming.

As k depends on both lengths, an evaluation string is cut anew for each band of training lengths it can meet, with the k of
that band, and a training string meets the segments of its own band only. Segments are cut where they become selective: a
segment ends as soon as its words' shares in the training texts, multiplied, fall under a level, and the highest level that
still yields k + 1 segments is used; at the lowest every word is a segment. A training string has, for each level, exactly one
such run at each place, so common words never make a join key alone unless nothing better exists. Training runs meet a Bloom
filter of the evaluation segments before they leave their task, and keys that are hot on a side are salted on it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.llm.reading import HASHES, words
from tonearm.operators.skew import HOT_ROWS, HOT_SHARE, salted_join
from tonearm.storage import cut

UNIT = 1024
COMMON_SHARE, COMMON_MOST, VERY_COMMON = 1e-4, 300_000, 0.2
BLOOM_BITS, KEY_BITS, CHUNK = 1 << 28, 8, 1 << 16
_M = np.uint64(0x9E3779B97F4A7C15)
#: Least lengths of the bands, each twice the one before; sets on whose runs hot keys are estimated.
BANDS = 1 << np.arange(40)
RUN_SAMPLE = 16_384


def band(n: np.ndarray | int) -> np.ndarray:
    """The band of a length in words."""
    return np.searchsorted(BANDS, n, "right")


def most_edits(n: int, m: int, t: Fraction) -> int:
    """The largest insert-delete distance of word strings of n and m different words with a Jaccard similarity of t."""
    p, q = t.numerator, t.denominator
    return n + m - 2 * -(-p * (n + m) // (p + q))


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_sets(df: DataFrame, id_col: str, text: str, least: int) -> DataFrame:
    """(id, cls, w): texts with at least so many different words; cls, a 64-bit hash, tells equal sets of words, w holds their
    sorted hashes.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, cls, ws = [], [], []
            for i, s in zip(b.column(0).to_pylist(), b.column(1)):
                if i is None or not s.is_valid:
                    continue
                w = np.unique(HASHES.of(list(set(words(s.as_py())))))
                if len(w) >= least:
                    raw = w.tobytes()
                    ids.append(i)
                    cls.append(xxhash.xxh3_64_intdigest(raw) - (1 << 63))
                    ws.append(raw)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(cls, pa.int64()), pa.array(ws, pa.binary())], ["id", "cls", "w"])

    source = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("s")).where("id is not null and s is not null")
    return source.mapInArrow(rows, "id bigint, cls bigint, w binary")


class Selectivity:
    """Levels and the share of common words, in whole units so that both sides cut alike."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, texts: int, bar: float):
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        share = counts[order] / max(texts, 1)
        self.gain = np.where(share > VERY_COMMON, 0, np.round(-np.log(np.maximum(share, 1e-300)) * UNIT)).astype(np.int64)
        self.rare = max(1, round(-math.log(bar) * UNIT))
        top = max(math.log(max(texts, 2) / 10), 2.0)
        self.levels = [round(x * UNIT) for x in np.arange(top, 1.9, -1.6)] + [0]

    def gains(self, w: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(w), self.rare, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, w), len(self.hashes) - 1)
        return np.where(self.hashes[at] == w, self.gain[at], self.rare)


def learn_selectivity(sets: DataFrame) -> Selectivity:
    """Counts words over all sets; those of a share of COMMON_SHARE and more are kept, at most COMMON_MOST words."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["h", "c"])

        for b in batches:
            held.append(np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint64))
            if sum(map(len, held)) > 4_000_000:
                yield flush()
        if held:
            yield flush()

    size = sets.agg(F.count(F.lit(1)).alias("texts"), F.sum(F.octet_length("w") / 8).alias("words")).first()
    texts, total = size.texts, size.words or 0
    bar = max(COMMON_SHARE, total / (max(texts, 1) * COMMON_MOST))
    per = sets.select("w").mapInArrow(counts, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))
    rows = per.where(F.col("c") >= max(2, bar * texts)).toPandas()
    return Selectivity(rows["h"].to_numpy(np.int64).view(np.uint64), rows["c"].to_numpy(np.int64), texts, bar)


class _Batch:
    """Runs of a batch of word strings: flat words, their sums and a 64-bit signature of each string."""

    def __init__(self, raws: list[bytes], sel: Selectivity):
        self.n = np.array([len(r) // 8 for r in raws], np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.n)))
        w = np.frombuffer(b"".join(raws), np.uint64)
        self.total = len(w)
        self.gain = np.concatenate(([0], np.cumsum(sel.gains(w))))
        with np.errstate(over="ignore"):
            self.sum = np.concatenate(([np.uint64(0)], np.cumsum(_mix(w), dtype=np.uint64)))
        self.text = np.repeat(np.arange(len(raws)), self.n)
        self.stop = self.start[1:][self.text]
        bit = np.uint64(1) << (w & np.uint64(63))
        self.sig = np.bitwise_or.reduceat(bit, self.start[:-1]) if self.total else np.zeros(len(raws), np.uint64)

    def ends(self, level: int, gain: int) -> np.ndarray:
        """For each place the end of its run, or more than the string's end if it has none."""
        here = np.arange(self.total)
        if gain == 0:
            return here + 1
        return np.searchsorted(self.gain, self.gain[:-1] + gain, "left")

    def keys(self, level: np.ndarray | int, bands: np.ndarray, a: np.ndarray, e: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mix(self.sum[e] - self.sum[a] + (64 * bands + level + 1).astype(np.uint64) * _M)


def _different(b: pa.RecordBatch) -> tuple[np.ndarray, list[bytes]]:
    """The classes of a batch, each once, so that copies don't multiply."""
    cls, first = np.unique(b.column(0).to_numpy(), return_index=True)
    return cls, b.column(1).take(pa.array(first)).to_pylist()


_SEGMENT = "key bigint, cls_a bigint, n int, p int, s bigint"


def _chain(batch: _Batch, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, begin, end) of the runs that follow one another from each string's begin at a level."""
    x, at = np.arange(len(batch.n)), batch.start[:-1]
    out = [np.empty((0, 3), np.int64)]
    while True:
        on = at < batch.start[1:][x]
        x, at = x[on], at[on]
        e = end[at]
        on = e <= batch.start[1:][x]
        x, at, e = x[on], at[on], e[on]
        if not len(x):
            break
        out.append(np.stack([x, at, e], axis=1))
        at = e
    return tuple(np.concatenate(out).T)


def _segments(sel_sent, t: Fraction):
    def bands_of(n: int) -> list[tuple[int, int]]:
        """The bands of the lengths that a string of n words can meet, each with the most edits."""
        most: dict[int, int] = {}
        for m in range(math.ceil(t * n), math.floor(n / t) + 1):
            y = int(band(m))
            most[y] = max(most.get(y, 0), most_edits(n, m, t))
        return list(most.items())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sel, edits = sel_sent.value, {}
        for b in batches:
            cls, raws = _different(b)
            if not len(cls):
                continue
            batch = _Batch(raws, sel)
            sizes, which = np.unique(batch.n, return_inverse=True)
            for n in sizes.tolist():
                if n not in edits:
                    edits[n] = bands_of(n)
            per = [edits[n] for n in sizes.tolist()]
            most = max(map(len, per))
            table = np.full((2, most, len(sizes)), -1)
            for i, own in enumerate(per):
                for j, (y, k) in enumerate(own):
                    table[:, j, i] = y, k
            of_band, of_edits = table[:, :, which]
            # The runs of each level, each string's best ones first; a band takes those of the highest level that has enough.
            level_of = np.full((most, len(cls)), -1)
            chains = []
            for level, gain in enumerate(sel.levels):
                x, at, e = _chain(batch, batch.ends(level, gain))
                order = np.lexsort((at, batch.gain[at] - batch.gain[e], x))
                x, at, e = x[order], at[order], e[order]
                counts = np.bincount(x, minlength=len(cls))
                chains.append((x, at, e, np.arange(len(x)) - (np.cumsum(counts) - counts)[x]))
                level_of[(level_of < 0) & (of_edits >= 0) & (counts[None] > of_edits)] = level
            got = [np.empty((0, 5), np.int64)]
            for level, (x, at, e, place) in enumerate(chains):
                for j in range(most):
                    m = (level_of[j][x] == level) & (place <= of_edits[j][x])
                    got.append(np.stack([np.full(int(m.sum()), level), at[m], e[m], x[m], of_band[j][x[m]]], axis=1))
            level, at, e, x, y = np.concatenate(got).T
            key = batch.keys(level, y, at, e)
            i32 = pa.int32()
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(cls[x]), pa.array(batch.n[x], i32), pa.array(at - batch.start[x], i32), pa.array(batch.sig[x].view(np.int64))],
                ["key", "cls_a", "n", "p", "s"],
            )

    return rows


def _spots(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    mask = np.uint64(bits - 1)
    yield keys & mask
    more = _mix(keys + _M)
    yield more & mask
    yield (more >> np.uint64(32)) & mask


def _may_hold(filter_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the filter may hold each key; the second and third bit are looked up only where the first is set."""
    mask = np.uint64(len(filter_) * 8 - 1)
    held = lambda spot: (filter_[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1 == 1
    some = np.flatnonzero(held(keys & mask))
    more = _mix(keys[some] + _M)
    some = some[held(more & mask) & held((more >> np.uint64(32)) & mask)]
    keep = np.zeros(len(keys), bool)
    keep[some] = True
    return keep


def bloom(keys: DataFrame, count: int) -> np.ndarray:
    """A Bloom filter, as bytes, of at most BLOOM_BITS bits, of a column of 64-bit keys; its parts are united by Spark."""
    bits = min(BLOOM_BITS, 1 << max(20, math.ceil(math.log2(max(count, 1) * 16))))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(bits, bool)
        for b in batches:
            for spot in _spots(b.column(0).to_numpy().view(np.uint64), bits):
                mine[spot] = True
        packed = np.packbits(mine, bitorder="little").reshape(-1, min(CHUNK, bits // 8))
        some = np.flatnonzero(packed.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([packed[i].tobytes() for i in some], pa.binary())], ["c", "v"])

    def unite(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in pdf["v"]])
        return pd.DataFrame({"c": [key[0]], "v": [v.tobytes()]})

    schema = "c bigint, v binary"
    out = np.zeros(bits // 8, np.uint8)
    size = min(CHUNK, bits // 8)
    for r in keys.mapInArrow(local, schema).groupBy("c").applyInPandas(unite, schema).toLocalIterator():
        out[r.c * size : (r.c + 1) * size] = np.frombuffer(r.v, np.uint8)
    return out


_RUN = "key bigint, cls_b bigint, m int, p2 int, s2 bigint"


def _runs(sel_sent, bloom_sent):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sel, filter_ = sel_sent.value, bloom_sent.value
        for b in batches:
            cls, raws = _different(b)
            batch = _Batch(raws, sel)
            got: list[tuple[np.ndarray, np.ndarray]] = []
            bands = band(batch.n)
            for level, gain in enumerate(sel.levels):
                e = batch.ends(level, gain)
                a = np.flatnonzero(e <= batch.stop)
                key = batch.keys(level, bands[batch.text[a]], a, e[a])
                keep = _may_hold(filter_, key)
                got.append((key[keep], a[keep]))
            key = np.concatenate([k for k, _ in got])
            a = np.concatenate([x for _, x in got])
            if not len(key):
                continue
            x = batch.text[a]
            i32 = pa.int32()
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(cls[x]), pa.array(batch.n[x], i32), pa.array(a - batch.start[x], i32), pa.array(batch.sig[x].view(np.int64))],
                ["key", "cls_b", "m", "p2", "s2"],
            )

    return rows


def _words_of(sets: DataFrame, classes: DataFrame, count: int, name: str, column: str) -> DataFrame:
    """(name, column): the words of the classes (c bigint); sets that the classes' Bloom filter excludes aren't shuffled."""
    sent = sets.sparkSession.sparkContext.broadcast(bloom(classes, count))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cls, first = np.unique(b.column(0).to_numpy(), return_index=True)
            keep = first[_may_hold(sent.value, cls.view(np.uint64))]
            yield b.take(pa.array(keep))

    some = sets.select("cls", "w").mapInArrow(rows, "cls bigint, w binary")
    return some.groupBy(F.col("cls").alias(name)).agg(F.first("w").alias(column))


def banded_distance(a: list[np.ndarray], b: list[np.ndarray], k: np.ndarray) -> np.ndarray:
    """Insert-delete distances of pairs of word strings by dynamic programming in the band of max(k); above k: some value above k."""
    if not a:
        return np.empty(0, np.int32)
    pairs, band = len(a), int(k.max())
    n, m = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    rows, cols = int(n.max(initial=0)), int(m.max(initial=0))
    left, right = np.zeros((rows, pairs), np.uint64), np.ones((cols + 2 * band + 1, pairs), np.uint64)
    for i in range(pairs):
        left[: n[i], i] = a[i]
        right[: m[i], i] = b[i]
    far = np.int32(1 << 20)
    width = 2 * band + 1
    before = np.full((width + 2, pairs), far, np.int32)
    for d in range(width):
        if 0 <= d - band <= cols:
            before[d + 1] = d - band
    out = np.full(pairs, far, np.int32)

    def settle(i: int, row: np.ndarray) -> None:
        done = np.flatnonzero(n == i)
        at = m[done] - i + band
        ok = (at >= 0) & (at < width)
        out[done[ok]] = row[at[ok] + 1, done[ok]]

    settle(0, before)
    for i in range(1, rows + 1):
        now = np.full((width + 2, pairs), far, np.int32)
        for d in range(width):
            j = i + d - band
            if j < 0 or j > cols:
                continue
            if j == 0:
                now[d + 1] = i
                continue
            step = np.minimum(before[d + 2], now[d]) + 1
            same = left[i - 1] == right[j - 1]
            now[d + 1] = np.where(same, np.minimum(before[d + 1], step), step)
        settle(i, now)
        before = now
    return out


def _verify(t: Fraction):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                a = [np.frombuffer(x, np.uint64) for x in part.column(2).to_pylist()]
                b = [np.frombuffer(x, np.uint64) for x in part.column(3).to_pylist()]
                k = np.array([most_edits(len(x), len(y), t) for x, y in zip(a, b)])
                wide = np.array([max(len(x), len(y)) for x, y in zip(a, b)])
                dist = np.zeros(len(a), np.int32)
                for some in np.array_split(np.argsort(wide), max(1, len(a) // 512)):
                    if len(some):
                        dist[some] = banded_distance([a[i] for i in some], [b[i] for i in some], k[some])
                good = np.flatnonzero(dist <= k)
                sizes = np.array([len(x) + len(y) for x, y in zip(a, b)])
                both = (sizes - dist) / 2
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(good)), part.column(1).take(pa.array(good)), pa.array((both / (sizes - both))[good])], ["cls_a", "cls_b", "similarity"]
                )

    return rows


def _salted(some: DataFrame, runs: DataFrame, samples: list[tuple[DataFrame, float]]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Segments and runs with the columns to join them by: the rows of a key that is hot on a side are salted there and met by
    copies of the other side's, so that no task has more than a bounded part of a key. Hot keys are at most HOT_SHARE a side:
    those with more than HOT_ROWS rows and than that share of them all. How many rows a key has is estimated on samples of the
    sides (keys, factor), since the estimate decides over the plan only.
    """
    per: dict[int, list[int]] = {}
    for side, (rows, times) in enumerate(samples):
        counts = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "counts")
        bound = max(HOT_ROWS, (counts.agg(F.sum("n")).first()[0] or 0) * times / HOT_SHARE)
        for r in counts.where(F.col("n") * times > bound).collect():
            per.setdefault(r.key, [1, 1])[side] = math.ceil(r.n * times / bound)
    if not per:
        return some, runs, ["key"]
    table = F.broadcast(some.sparkSession.createDataFrame([(k, *v) for k, v in per.items()], "key bigint, __na int, __nb int"))
    a, b = (t.join(table, "key", "left").fillna(1, ["__na", "__nb"]) for t in (some, runs))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = a.withColumn("__sa", F.pmod(F.xxhash64("cls_a"), F.col("__na")).cast("int")).withColumn("__sb", spread("__nb"))
    b = b.withColumn("__sb", F.pmod(F.xxhash64("cls_b"), F.col("__nb")).cast("int")).withColumn("__sa", spread("__na"))
    return a.drop("__na", "__nb"), b.drop("__na", "__nb"), ["key", "__sa", "__sb"]


def similar_classes(left: DataFrame, right: DataFrame, threshold: Fraction) -> DataFrame:
    """(cls_a, cls_b, similarity) of all pairs of classes of word_sets() with a Jaccard similarity of the threshold."""
    spark = left.sparkSession
    sel_sent = spark.sparkContext.broadcast(learn_selectivity(right))
    segments = cut(left.select("cls", "w").mapInArrow(_segments(sel_sent, threshold), _SEGMENT), "segments")
    count = segments.count()
    blocks = max(1, -(-count // (BLOOM_BITS // KEY_BITS)))
    texts, asked = right.count(), left.count()
    n, m = F.col("n"), F.col("m")
    p, q = threshold.numerator, threshold.denominator
    k = n + m - 2 * F.ceil((p * (n + m)) / F.lit(p + q) - 1e-9)
    shift = F.abs(F.col("p2") - F.col("p")) + F.abs((m - F.col("p2")) - (n - F.col("p")))
    differ = F.bit_count(F.col("s").bitwiseXOR(F.col("s2")))
    pairs = None
    for i in range(blocks):
        some = segments if blocks == 1 else segments.where(F.pmod(F.xxhash64("cls_a"), F.lit(blocks)) == i)
        sent = spark.sparkContext.broadcast(bloom(some.select("key"), -(-count // blocks)))
        run = lambda rows: rows.select("cls", "w").mapInArrow(_runs(sel_sent, sent), _RUN)
        least = lambda c, n: F.pmod(F.xxhash64(c), F.lit(1 << 30)) < int((1 << 30) * min(1.0, RUN_SAMPLE / max(n, 1)))
        samples = [
            (some.where(least("cls_a", asked)).select("key"), max(1.0, asked / RUN_SAMPLE)),
            (run(right.where(least("cls", texts))).select("key"), max(1.0, texts / RUN_SAMPLE)),
        ]
        a, b, by = _salted(some, run(right), samples)
        met = a.join(b, by).where((q * m >= p * n) & (q * n >= p * m) & (shift <= k) & (differ <= k))
        met = met.select("cls_a", "cls_b")
        pairs = met if pairs is None else pairs.union(met)
    pairs = cut(pairs.distinct(), "candidates")
    found = pairs.count()
    a = _words_of(left, pairs.select("cls_a"), found, "cls_a", "wa")
    b = _words_of(right, pairs.select("cls_b"), found, "cls_b", "wb")
    full = pairs.join(a, "cls_a").join(b, "cls_b").select("cls_a", "cls_b", "wa", "wb")
    return full.mapInArrow(_verify(threshold), "cls_a bigint, cls_b bigint, similarity double")


def near_same(
    evals: DataFrame, train: DataFrame, eval_id: str, eval_text: str, train_id: str, train_text: str, threshold: str = "0.7", least: int = 8
) -> DataFrame:
    """(eval, train, similarity) of all records whose texts have at least least different words and a Jaccard similarity of
    their sets of words of at least threshold (a decimal fraction, taken exactly).

    Ids are bigint. Null ids and texts, and texts with fewer words, give no row. Records with equal sets of words are compared
    once, as a class, and expanded at the end; a record delivered twice counts once. Texts of any length are read whole.
    """
    t = Fraction(threshold)
    a = cut(word_sets(evals, eval_id, eval_text, least), "sets")
    b = cut(word_sets(train, train_id, train_text, least), "sets")
    pairs = similar_classes(a, b, t)
    left = cut(a.select(F.col("id").alias("eval"), F.col("cls").alias("cls_a")).distinct(), "members")
    right = cut(b.select(F.col("id").alias("train"), F.col("cls").alias("cls_b")).distinct(), "members")
    half = cut(salted_join(cut(pairs, "pairs"), left, "cls_a").select("eval", "cls_b", "similarity"), "half")
    return salted_join(half, right, "cls_b").select("eval", "train", "similarity")
