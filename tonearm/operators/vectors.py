"""Vectors in tables: geometry of centroids, alignment, distances of sets, histograms, exact similarity joins, greedy dedup."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonearm.functions.arrays import dot, doubles, unit
from tonearm.operators.attribution import gram, rows_of
from tonearm.storage import cut


def centroids(df: DataFrame, key: str, vector: str, normalise: bool = True) -> DataFrame:
    """(key, n, centroid): the mean of each key's vectors, brought to unit length if asked.

    Components are averaged position by position, pre-aggregated in the map tasks, so a hot key costs no task more. Null
    vectors don't count.
    """
    cells = df.where(F.col(vector).isNotNull()).select(key, F.posexplode(doubles(vector)).alias("__p", "__x"))
    means = cells.groupBy(key, "__p").agg(F.avg("__x").alias("__x"), F.count(F.lit(1)).alias("__n"))
    lists = means.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__p", "__x"))).alias("__c"), F.max("__n").alias("n"))
    c = F.transform("__c", lambda s: s["__x"])
    return lists.select(key, "n", (unit(c) if normalise else c).alias("centroid"))


def coherence(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, n, coherence): the mean cosine of different vectors of a key; 1.0 for a single vector.

    From |sum v|^2 - sum |v|^2 of the unit vectors, so it is linear in the rows and needs no self-join.
    """
    units = df.where(F.col(vector).isNotNull()).select(key, unit(vector).alias("__u"))
    cells = units.select(key, F.posexplode("__u").alias("__p", "__x")).groupBy(key, "__p").agg(F.sum("__x").alias("__s"), F.sum(F.col("__x") * F.col("__x")).alias("__q"), F.count(F.lit(1)).alias("__n"))
    per = cells.groupBy(key).agg(F.sum(F.col("__s") * F.col("__s")).alias("__ss"), F.sum("__q").alias("__qq"), F.max("__n").alias("n"))
    pairs = F.col("n") * (F.col("n") - 1)
    return per.select(key, "n", F.when(F.col("n") < 2, 1.0).otherwise(F.try_divide(F.col("__ss") - F.col("__qq"), pairs)).alias("coherence"))


def distinctiveness(cents: DataFrame, key: str, vector: str = "centroid", block: int = 4096) -> DataFrame:
    """(key, to_grand, to_nearest): one minus the cosine with the mean of all centroids, and with the nearest other one.

    A single centroid has 1.0 to the nearest. Centroids meet each other in blocks of a stated set.
    """
    grand = centroids(cents.withColumn("__g", F.lit(0)), "__g", vector).select(F.col("centroid").alias("__grand"))
    one = cents.withColumn("__k", F.lit(1)).join(F.broadcast(grand.withColumn("__k", F.lit(1))), "__k")
    to_grand = one.select(key, (1 - dot(unit(vector), "__grand")).alias("to_grand"))
    best = best_other(cents, key, vector, block)
    return to_grand.join(best, key, "left").select(key, "to_grand", (1 - F.coalesce("best", F.lit(0.0))).alias("to_nearest"))


def best_other(df: DataFrame, key: str, vector: str, block: int = 4096) -> DataFrame:
    """(key, best): the largest cosine with a vector of another key."""
    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key).alias("k"), unit(vector).alias("v")).where("k is not null and v is not null")
    blocks = max(1, -(-rows.count() // block))
    out = None
    for i in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("k"), F.lit(blocks)) == i).collect()
        if not part:
            continue
        number = {k: i for i, k in enumerate(dict.fromkeys(r.k for r in part))}
        sent = df.sparkSession.sparkContext.broadcast((number, np.array([number[r.k] for r in part]), np.array([r.v for r in part])))

        def scan(batches, sent=sent):
            number, theirs, y = sent.value
            for b in batches:
                if not b.num_rows:
                    continue
                own = np.array([number.get(k, -1) for k in b.column(0).to_pylist()])
                sim = rows_of(b.column(1)) @ y.T
                sim[own[:, None] == theirs[None, :]] = -2.0
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sim.max(1))], ["k", "best"])

        hit = rows.mapInArrow(scan, f"k {kind}, best double").where("best > -1.5")
        out = hit if out is None else out.union(hit)
    if out is None:
        return rows.select(F.col("k").alias(key), F.lit(0.0).alias("best")).limit(0)
    return out.groupBy(F.col("k").alias(key)).agg(F.max("best").alias("best"))


def alignment(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: mean and population deviation of the cosines of paired vectors (norms raised by 1e-8), and their number."""
    cos = dot(unit(a, "add"), unit(b, "add"))
    return pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(cos.alias("__c")).agg(
        F.avg("__c").alias("mean"), F.stddev_pop("__c").alias("std"), F.count(F.lit(1)).alias("n")
    )


def moments(df: DataFrame, vector: str, d: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, sample covariance) of vectors, from sums made where the rows are; the covariance is NaN for n < 2."""
    rows = df.select(doubles(vector).alias("v")).where("v is not null").select(F.concat(F.array(F.lit(1.0)), F.slice("v", 1, d)).alias("v"))
    sums = gram(rows, "v", d + 1)  # a one before each vector gives the number and the sums too
    n, s, q = int(sums[0, 0]), sums[0, 1:], sums[1:, 1:]
    mean = s / max(n, 1)
    cov = (q - n * np.outer(mean, mean)) / (n - 1) if n > 1 else np.full((d, d), np.nan)
    return n, mean, cov


def frechet_distance(a: DataFrame, b: DataFrame, vector: str, d: int, eps: float = 1e-6) -> float | None:
    """|m1 - m2|^2 + tr(C1 + C2 - 2 (C1 C2)^(1/2)); null if a side has fewer than two vectors."""
    (n1, m1, c1), (n2, m2, c2) = moments(a, vector, d), moments(b, vector, d)
    if n1 < 2 or n2 < 2:
        return None

    def root_trace(x: np.ndarray, y: np.ndarray) -> float:
        w, v = np.linalg.eigh(x)
        half = (v * np.sqrt(np.maximum(w, 0))) @ v.T
        return float(np.sqrt(np.maximum(np.linalg.eigvalsh(half @ y @ half), 0)).sum())

    trace = root_trace(c1, c2)
    if not np.isfinite(trace):
        trace = root_trace(c1 + eps * np.eye(d), c2 + eps * np.eye(d))
    return float((m1 - m2) @ (m1 - m2) + np.trace(c1) + np.trace(c2) - 2 * trace)


def kernel_mean(a: DataFrame, b: DataFrame, vector: str, kernel: str = "rational", bandwidths: Sequence[float] = (1.0,), block: int = 4096) -> float | None:
    """The mean over all pairs of a kernel of the mean squared difference: 1 / (1 + d / 2w) averaged over the bandwidths, or
    exp(-d / size). b is a stated set that meets all of a in blocks.
    """
    rows = b.select(doubles(vector).alias("v")).where("v is not null")
    base = a.select(doubles(vector).alias("v")).where("v is not null")
    n = rows.count()
    blocks = max(1, -(-n // block))
    total, pairs = 0.0, 0
    for i in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("v"), F.lit(blocks)) == i)
        held = np.array([r.v for r in part.collect()], float)
        if not len(held):
            continue
        sent = a.sparkSession.sparkContext.broadcast(held)

        def scan(batches, sent=sent):
            y = sent.value
            s, c = 0.0, 0
            for b_ in batches:
                if not b_.num_rows:
                    continue
                x = rows_of(b_.column(0))
                d2 = np.maximum((x**2).mean(1)[:, None] + (y**2).mean(1)[None] - 2 * (x @ y.T) / x.shape[1], 0)
                k = np.exp(-d2 / x.shape[1]) if kernel == "gaussian" else sum(1 / (1 + d2 / (2 * w)) for w in bandwidths) / len(bandwidths)
                s, c = s + float(k.sum()), c + k.size
            yield pa.RecordBatch.from_pydict({"s": [s], "c": [c]})

        got = base.mapInArrow(scan, "s double, c bigint").agg(F.sum("s").alias("s"), F.sum("c").alias("c")).first()
        total, pairs = total + (got.s or 0.0), pairs + (got.c or 0)
    return total / pairs if pairs else None


def discrepancy(a: DataFrame, b: DataFrame, vector: str, kernel: str = "rational", bandwidths: Sequence[float] = (1.0,)) -> float | None:
    """The maximum mean discrepancy of two sets: mean kernel within each less twice that between them; null for an empty set."""
    k = [kernel_mean(x, y, vector, kernel, bandwidths) for x, y in ((a, a), (b, b), (a, b))]
    return None if None in k else k[0] + k[1] - 2 * k[2]


def principal_directions(df: DataFrame, vector: str, d: int, k: int = 3) -> np.ndarray:
    """The k directions of largest variance as rows, the largest component of each positive."""
    _, _, cov = moments(df, vector, d)
    w, v = np.linalg.eigh(cov)
    top = v[:, np.argsort(-w)[:k]].T
    return top * np.sign(top[np.arange(k), np.abs(top).argmax(1)])[:, None]


def projected(df: DataFrame, vector: str, d: int, k: int = 3, name: str = "projection") -> DataFrame:
    """df with the first k principal components of its centred vectors."""
    _, mean, _ = moments(df, vector, d)
    parts = []
    for row in principal_directions(df, vector, d, k):
        offset = float(row @ mean)
        parts.append(dot(vector, F.array(*(F.lit(float(x)) for x in row))) - offset)
    return df.withColumn(name, F.array(*parts))


def histogram(df: DataFrame, value: str, bins: int, log: bool = False) -> DataFrame:
    """(bin, low, high, n): equal bins from the least to the largest value, or of equal ratio from 1 to the largest plus 1.

    Bins are closed on the left, the last on both sides; empty bins are given. Nulls aren't counted.
    """
    v = F.col(value).cast("double")
    ends = df.agg(F.min(v).alias("a"), F.max(v).alias("b")).first()
    spark = df.sparkSession
    schema = "bin int, low double, high double, n bigint"
    if ends.a is None:
        return spark.createDataFrame([], schema)
    a, b = (0.0, math.log10(ends.b + 1)) if log else (ends.a, ends.b)
    if a == b:
        a, b = a - 0.5, b + 0.5
    edges = [a + (b - a) * i / bins for i in range(bins + 1)]
    edges = [10**e for e in edges] if log else edges
    at = F.lit(0)
    place = F.size(F.filter(F.array(*(F.lit(e) for e in edges[1:-1])), lambda e: e <= v)) if bins > 1 else at
    counts = df.where(v.isNotNull() & (v >= edges[0]) & (v <= max(edges[-1], ends.b))).groupBy(place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    frame = spark.createDataFrame([(i, edges[i], edges[i + 1]) for i in range(bins)], "bin int, low double, high double")
    return frame.join(counts, "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"))


def code_histogram(df: DataFrame, key: str, book: str | None, code: str, size: int) -> DataFrame:
    """(key, book, code, weight): the sparse histogram feature of a key's codes: each code book's counts (or all books', book
    -1) as shares of their total, the whole brought to unit length. A code of size or more is an error.
    """
    b = F.col(book) if book else F.lit(-1)
    ok = F.when(F.col(code) < size, F.col(code)).otherwise(F.raise_error(F.lit("a code is not below the code book's size")).cast("bigint"))
    per = df.where(F.col(code).isNotNull()).groupBy(key, b.cast("int").alias("book"), ok.cast("int").alias("code")).agg(F.count(F.lit(1)).alias("__n"))
    sums = per.groupBy(F.col(key).alias("__k"), F.col("book").alias("__b")).agg(F.sum("__n").alias("__t"))
    share = per.join(sums, F.col(key).eqNullSafe(F.col("__k")) & (F.col("book") == F.col("__b"))).select(key, "book", "code", (F.col("__n") / F.col("__t")).alias("__w"))
    norms = share.groupBy(F.col(key).alias("__k")).agg(F.sqrt(F.sum(F.col("__w") * F.col("__w"))).alias("__l"))
    return share.join(norms, F.col(key).eqNullSafe(F.col("__k"))).select(key, "book", "code", (F.col("__w") / F.col("__l")).alias("weight"))


#: Pivots and the sample they are taken from, rows of a block, blocks whose ranges are sent at a time.
PIVOTS, PIVOT_SAMPLE, SUBBLOCK, SENT_BLOCKS = 256, 20_000, 2_048, 20_000


def _pivots(x: np.ndarray, most: int) -> np.ndarray:
    """Rows of x that lie far from each other, by the first row and then always the one farthest from those taken."""
    taken = [x[0]]
    near = x @ x[0]
    for _ in range(most - 1):
        taken.append(x[int(near.argmin())])
        near = np.maximum(near, x @ taken[-1])
    return np.array(taken)


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1, 1))


def _blocks(sent):
    """Rows sorted by cell and angle in blocks of SUBBLOCK; a block's first row has the ranges of its angles to all pivots."""

    def rows(batches):
        pid, held, no = TaskContext.get().partitionId(), [], 0

        def emit(ids: np.ndarray, x: np.ndarray, no: int) -> pa.RecordBatch:
            angles = _angles(x, sent.value)
            ends = [pa.array([e.astype(np.float32).tobytes(), *[None] * (len(ids) - 1)], pa.binary()) for e in (angles.min(0) - 1e-6, angles.max(0) + 1e-6)]
            blk = np.full(len(ids), (pid << 32) + no, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(blk), pa.array(ids), pa.array([v.tobytes() for v in x], pa.binary()), *ends], ["blk", "id", "v", "lo", "hi"])

        for b in batches:
            if b.num_rows:
                held.append((b.column(0).to_numpy(), rows_of(b.column(1))))
            while sum(len(i) for i, _ in held) >= SUBBLOCK:
                ids, x = np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held])
                yield emit(ids[:SUBBLOCK], x[:SUBBLOCK], no)
                held, no = [(ids[SUBBLOCK:], x[SUBBLOCK:])], no + 1
        if held and (ids := np.concatenate([i for i, _ in held])).size:
            yield emit(ids, np.concatenate([v for _, v in held]), no)

    return rows


def _near_blocks(sent, reach: float):
    """Pairs (a, b), a <= b, of blocks whose ranges of angles to every pivot come within reach."""

    def rows(batches):
        others, lo, hi = sent.value
        for b in batches:
            out = [np.empty((0, 2), np.int64)]
            for blk, low, high in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                low, high = np.frombuffer(low, np.float32), np.frombuffer(high, np.float32)
                met = others[((lo - high <= reach) & (low - hi <= reach)).all(1) & (others >= blk)]
                out.append(np.stack([np.full(len(met), blk), met], axis=1))
            pairs = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return rows


def similar_pairs(df: DataFrame, id_col: str, vector: str, threshold: float, seed: int = 0) -> DataFrame:
    """(a, b, similarity), a < b, of all rows whose vectors have a cosine of at least threshold; exact.

    Rows are sorted by their nearest pivot, of at most PIVOTS from a bounded sample, and their angle to it, and cut into blocks
    of equal size. By the triangle inequality of angles two blocks can hold a similar pair only if their ranges of angles to
    every pivot come within the threshold's angle, so each block meets the blocks near it, once each, and no row is copied for
    others; blocks are multiplied as matrices. Null and zero vectors have no pairs. For copies, give different vectors only
    and keep their members aside.
    """
    kept = "id is not null and v is not null and exists(v, x -> x <> 0)"
    rows = cut(df.select(F.col(id_col).cast("bigint").alias("id"), unit(vector).alias("v")).where(kept), "units")
    n = rows.count()
    spark = df.sparkSession
    empty = "a bigint, b bigint, similarity double"
    if n < 2:
        return spark.createDataFrame([], empty)
    some = rows.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) <= int((1 << 30) * min(1.0, PIVOT_SAMPLE / n)))
    x = np.array([r.v for r in some.orderBy("id").limit(2 * PIVOT_SAMPLE).collect()])
    sent = spark.sparkContext.broadcast(_pivots(x, min(PIVOTS, len(x), max(1, n // 64))))

    def home(batches):
        for b in batches:
            if b.num_rows:
                angles = _angles(rows_of(b.column(1)), sent.value)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(angles.argmin(1).astype(np.int32)), pa.array(angles.min(1))], ["id", "v", "cell", "angle"])

    by = ["cell", "angle", "id"]
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // SUBBLOCK))
    homed = rows.mapInArrow(home, "id bigint, v array<double>, cell int, angle double")
    ranged = homed.repartitionByRange(parts, *by).sortWithinPartitions(*by).select("id", "v")
    blocked = cut(ranged.mapInArrow(_blocks(sent), "blk bigint, id bigint, v binary, lo binary, hi binary"), "blocks")
    ranges = blocked.where("lo is not null").select("blk", "lo", "hi")
    slices = max(1, -(-ranges.count() // SENT_BLOCKS))
    reach = math.acos(min(1.0, max(-1.0, threshold))) + 1e-6
    near = None
    for i in range(slices):
        held = ranges.where(F.pmod(F.xxhash64("blk"), F.lit(slices)) == i).collect()
        if not held:
            continue
        ends = [np.frombuffer(b"".join(r[c] for r in held), np.float32).reshape(len(held), -1) for c in ("lo", "hi")]
        others = spark.sparkContext.broadcast((np.array([r.blk for r in held]), *ends))
        one = ranges.mapInArrow(_near_blocks(others, reach), "a bigint, b bigint")
        near = one if near is None else near.union(one)
    near = cut(near, "near")

    def meet(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        p, q = (np.frombuffer(b"".join(v.tolist()), np.float64).reshape(len(v), -1) for v in (left["va"], right["vb"]))
        s = p @ q.T
        i, j = np.nonzero(s >= threshold)
        a, b = left["ia"].to_numpy()[i], right["ib"].to_numpy()[j]
        ok = a < b if key[0] == key[1] else a != b
        a, b = a[ok], b[ok]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "similarity": s[i, j][ok]})

    left = blocked.select(F.col("blk").alias("a"), F.col("id").alias("ia"), F.col("v").alias("va")).join(near, "a")
    right = blocked.select(F.col("blk").alias("b"), F.col("id").alias("ib"), F.col("v").alias("vb")).join(near, "b")
    return left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(meet, empty)


def greedy_keep_first(pairs: DataFrame) -> DataFrame:
    """(drop, keep, similarity) of a greedy scan in order of id, from all pairs (a, b, similarity), a < b: a row is kept unless
    a kept row before it is similar, and is dropped for the first such row.

    Each round settles every row all of whose earlier neighbours are settled, so there are as many rounds as the longest
    chain needs; only unsettled rows take part.
    """
    pairs = cut(pairs.select("a", "b", "similarity"), "pairs")
    kept = cut(pairs.select(F.col("a").alias("id")).distinct().join(pairs.select(F.col("b").alias("id")).distinct(), "id", "left_anti"), "kept")
    left, dropped = pairs, None
    fresh = kept
    while True:
        hit = left.join(fresh.select(F.col("id").alias("a")), "a")
        gone = cut(hit.select(F.col("b").alias("id")).distinct(), "gone")
        if gone.isEmpty():
            break
        dropped = gone if dropped is None else dropped.union(gone)
        left = left.join(fresh.select(F.col("id").alias("a")), "a", "left_anti").join(gone.select(F.col("id").alias("a")), "a", "left_anti")
        left = cut(left.join(gone.select(F.col("id").alias("b")), "b", "left_anti").select("a", "b", "similarity"), "left")
        waiting = left.select(F.col("b").alias("id")).distinct()
        free = left.select(F.col("a").alias("id")).distinct().join(waiting, "id", "left_anti")
        fresh = cut(free, "fresh")
        kept = kept.union(fresh)
        if left.isEmpty():
            break
    if dropped is None:
        return pairs.select(F.col("b").alias("drop"), F.col("a").alias("keep"), "similarity").limit(0)
    good = pairs.join(dropped.select(F.col("id").alias("b")), "b", "left_semi").join(dropped.select(F.col("id").alias("a")), "a", "left_anti")
    return good.groupBy(F.col("b").alias("drop")).agg(F.min("a").alias("keep"), F.min_by("similarity", "a").alias("similarity"))


def dedup(df: DataFrame, id_col: str, vector: str, threshold: float) -> DataFrame:
    """(drop, keep, similarity): greedy_keep_first() over all rows of df. Equal vectors are compared once, by their first row;
    the others go where it goes, or to it.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), doubles(vector).alias("v")).where("id is not null and v is not null")
    rows = cut(rows.groupBy("id").agg(F.min("v").alias("v")).withColumn("cls", F.md5(F.array_join(F.transform("v", lambda x: x.cast("string")), ","))), "rows")
    first = rows.groupBy("cls").agg(F.min("id").alias("id"), F.min_by("v", "id").alias("v"))
    done = greedy_keep_first(similar_pairs(first, "id", "v", threshold))
    copies = rows.join(first.select("cls", F.col("id").alias("rep")), "cls").where("id <> rep and exists(v, x -> x <> 0)").select(F.col("id").alias("drop"), "rep")
    kept = done.select(F.col("drop").alias("rep"), F.col("keep").alias("__keep"), F.col("similarity").alias("__s"))
    copies = copies.join(kept, "rep", "left").select("drop", F.coalesce("__keep", "rep").alias("keep"), F.coalesce("__s", F.lit(1.0)).alias("similarity"))
    return done.union(copies)


def largest_of_column(v: Column | str) -> Column:
    """The largest component of a vector."""
    return F.array_max(doubles(v))


def moment_penalty(df: DataFrame, key: str, vector: str) -> DataFrame:
    """One row: mean over keys and positions of mean^2 + var - log var - 1 along the rows of a key, and along each row.

    A key's rows are the channels of one latent, its positions the frames; variances are sample variances, at least 1e-4.
    """
    cells = df.where(F.col(vector).isNotNull()).withColumn("__r", F.monotonically_increasing_id()).select(key, "__r", F.posexplode(doubles(vector)).alias("__p", "__x"))

    def term(by: str) -> Column:
        per = cells.groupBy(key, by).agg(F.avg("__x").alias("m"), F.greatest(F.var_samp("__x"), F.lit(1e-4)).alias("v"))
        return per.agg(F.avg(F.col("m") * F.col("m") + F.col("v") - F.log("v") - 1).alias("t")).first().t

    rows, cols = term("__r"), term("__p")
    total = None if rows is None or cols is None else rows + 0.4 * cols
    return df.sparkSession.createDataFrame([(rows, cols, total)], "along_rows double, along_positions double, penalty double")


def compact_silence(
    df: DataFrame, key: str, signal: str, rate: int, threshold: float = 0.01, short: float = 0.5, longest: float = 0.25, seed: int = 0
) -> DataFrame:
    """df with signal compacted: a run of samples quieter than the threshold that is longer than longest seconds gives a part of
    it, short seconds long, from a place drawn by key and run (or from its start, if it isn't longer than that).
    """
    most, part = int(longest * rate), int(short * rate)

    @F.arrow_udf("array<double>")
    def compact(signals: pa.Array, keys: pa.Array) -> pa.Array:
        out = []
        for s, k in zip(signals, keys.to_pylist()):
            if not s.is_valid:
                out.append(None)
                continue
            x = np.asarray(s.values.to_numpy(zero_copy_only=False), float)
            quiet = np.concatenate(([False], np.abs(x) < threshold, [False]))
            edges = np.flatnonzero(quiet[1:] != quiet[:-1])
            keep = np.ones(len(x), bool)
            for a, b in zip(edges[0::2].tolist(), edges[1::2].tolist()):
                if b - a > most:
                    u = int(hashlib.md5(f"{seed}|{k}|{a}".encode()).hexdigest()[:10], 16) / float(1 << 40)
                    first = a + (int(u * (b - a - part + 1)) if b - a > part else 0)
                    keep[a:b] = False
                    keep[first : first + part] |= np.arange(first, min(first + part, len(x))) < b
            out.append(x[keep])
        return pa.array(out, pa.list_(pa.float64()))

    return df.withColumn(signal, compact(doubles(signal), F.col(key).cast("string")))


def silence_runs(df: DataFrame, key: str, signal: str, threshold: float = 0.01) -> DataFrame:
    """(key, start, size) of the maximal runs of samples quieter than the threshold, start from 0; gaps and islands."""
    cells = df.select(key, F.posexplode(doubles(signal)).alias("__p", "__x")).where(F.abs("__x") < threshold)
    island = F.col("__p") - F.row_number().over(Window.partitionBy(key).orderBy("__p"))
    return cells.withColumn("__g", island).groupBy(key, "__g").agg(F.min("__p").alias("start"), F.count(F.lit(1)).alias("size")).drop("__g")
