"""Mixing sources to target weights by the cube method.

A source that is to give r times its size gives every document floor(r) times and one more copy to documents chosen with
probability r - floor(r). The cube method moves these probabilities along the null space of the constraints (documents and
tokens of the source), until all but a few are 0 or 1, so that the totals are met exactly on the way. The flight runs in
blocks of bounded size, what they leave undecided flies again, and at most two documents of a source stay undecided. These
are landed together with a reserve of RESERVE short documents that didn't fly: all choices for the undecided are tried, the
reserve's probabilities are set to what tokens then remain, and the reserve flies last, so that what can't be met is a part
of a short document and not of a long one.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonearm.storage import cut

EPS = 1e-9
#: Documents of a block of the flight, and short documents of a source that are kept for the landing.
BLOCK, RESERVE = 4096, 256


def flight(x: np.ndarray, p: np.ndarray, seed: int) -> np.ndarray:
    """Probabilities after a flight that keeps sum(p) and sum(p * x); at most two stay between 0 and 1."""
    rng = np.random.default_rng(seed)
    draws = rng.random(2 * len(p) + 8)
    p, xs = p.astype(float).tolist(), x.astype(float).tolist()
    active: list[int] = []
    at = used = 0
    n = len(p)
    while True:
        while len(active) < 3 and at < n:
            if EPS < p[at] < 1 - EPS:
                active.append(at)
            else:
                p[at] = float(round(p[at]))
            at += 1
        if len(active) == 3:
            i, j, k = active
            v = (xs[k] - xs[j], xs[i] - xs[k], xs[j] - xs[i])
            if v == (0.0, 0.0, 0.0):
                v = (1.0, -1.0, 0.0)
        elif len(active) == 2 and xs[active[0]] == xs[active[1]]:
            v = (1.0, -1.0)
        else:
            break
        up = down = float("inf")
        for c, d in zip(active, v):
            if d > 0:
                up, down = min(up, (1 - p[c]) / d), min(down, p[c] / d)
            elif d < 0:
                up, down = min(up, -p[c] / d), min(down, (p[c] - 1) / d)
        step = up if draws[used] * (up + down) < down else -down
        used += 1
        stay = []
        for c, d in zip(active, v):
            p[c] += step * d
            if p[c] < EPS:
                p[c] = 0.0
            elif p[c] > 1 - EPS:
                p[c] = 1.0
            else:
                stay.append(c)
        if len(stay) == len(active):
            c = min(stay, key=lambda c: min(p[c], 1 - p[c]))
            p[c] = float(round(p[c]))
            stay.remove(c)
        active = stay
    return np.array(p)


def land(x: np.ndarray, p: np.ndarray, reserve: np.ndarray, seed: int) -> np.ndarray:
    """The landing: 0/1 choices for the undecided and the reserve whose tokens come closest to what was expected."""
    p = p.copy()
    want = float((p * x).sum())
    held = np.flatnonzero(reserve & (x > 0))
    open_ = np.flatnonzero((p > EPS) & (p < 1 - EPS) & ~(reserve & (x > 0)))
    usual, most = float((p[held] * x[held]).sum()), float(x[held].sum())
    choices = [np.array(c) for c in product((0.0, 1.0), repeat=len(open_))]
    rests = [want - float((np.delete(p, held) * np.delete(x, held)).sum()) + float((p[open_] * x[open_]).sum()) - float(np.dot(c, x[open_])) for c in choices]
    best = min(range(len(choices)), key=lambda i: (max(0.0, -rests[i], rests[i] - most), abs(rests[i] - usual)))
    p[open_] = choices[best]
    if len(held):
        rest = min(max(rests[best], 0.0), most)
        q = p[held]
        if rest <= usual:
            q = q * (rest / usual if usual > 0 else 0.0)
        else:
            q = 1 - (1 - q) * ((most - rest) / (most - usual) if most > usual else 0.0)
        q = flight(x[held], q, seed)
        left = np.flatnonzero((q > EPS) & (q < 1 - EPS))
        goal = float((q[left] * x[held][left]).sum())
        q[left] = min(product((0.0, 1.0), repeat=len(left)), key=lambda c: abs(float(np.dot(c, x[held][left])) - goal), default=())
        p[held] = q
    return p


def _fly(seed: int, last: bool):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        x, p = pdf["n_tokens"].to_numpy(float), pdf["p"].to_numpy(float)
        if last:
            held = pdf["reserve"].to_numpy(bool)
            flown = p.copy()
            flown[~held] = flight(x[~held], p[~held], _seed(seed, key))
            p = land(x, flown, held, _seed(seed + 1, key))
        else:
            p = flight(x, p, _seed(seed, key))
        return pdf.assign(p=p)[["id", "source", "n_tokens", "p"]]

    return run


def _seed(seed: int, key: tuple) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(map(str, key)), seed=seed)


def plan(totals: dict[str, int], targets: dict[str, tuple[float, int]], total_tokens: float | None = None) -> dict[str, float]:
    """How often each source is used. targets: share and max_repeats by source.

    Without total_tokens the mixture is the largest in which every source that has any tokens reaches its share. With it, a
    source too small for its share is used max_repeats times and the others aren't changed: the report shows the shortage.
    """
    usable = {s: (w, r) for s, (w, r) in targets.items() if w > 0 and r > 0 and totals.get(s, 0) > 0}
    if not usable:
        return {}
    whole = sum(w for w, _ in usable.values())
    if total_tokens is None:
        total_tokens = min(r * totals[s] / (w / whole) for s, (w, r) in usable.items())
    return {s: min(float(r), w / whole * total_tokens / totals[s]) for s, (w, r) in usable.items()}


def mix(docs: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 0) -> DataFrame:
    """(id, source, n_tokens, copies) of the mixture, copies > 0.

    docs: id, source, n_tokens; targets: source, target_share, max_repeats, at most 10,000 sources. Documents without a
    source of the targets, with null or no tokens, and sources of no share are left out. A repeated source in targets counts
    once, with its largest share. Equal seeds give equal mixtures. No documents: no rows.
    """
    rows = targets.groupBy("source").agg(F.max("target_share").alias("w"), F.max("max_repeats").alias("r")).where("source is not null")
    rows = rows.limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("more than 10,000 sources")
    known = docs.sparkSession.createDataFrame([(r.source,) for r in rows], "source string")
    wanted = docs.where("n_tokens > 0 and id is not null").join(F.broadcast(known), "source", "left_semi")
    docs = cut(wanted.select("id", "source", "n_tokens"), "sizes")
    sums = docs.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()
    uses = plan({r.source: r.t for r in sums}, {r.source: (float(r.w or 0), int(r.r or 0)) for r in rows}, total_tokens)
    spark = docs.sparkSession
    use = [(r.source, uses[r.source], -(-r.n // BLOCK), r.t / r.n) for r in sums if r.source in uses]
    use = spark.createDataFrame(use, "source string, use double, blocks int, mean double")
    placed = docs.join(F.broadcast(use), "source")
    placed = placed.withColumn("base", F.floor(F.col("use") + EPS)).withColumn("p", F.greatest(F.col("use") - F.col("base"), F.lit(0.0)))
    schema = "id bigint, source string, n_tokens bigint, p double"
    near = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed), "id"), "id")
    short = placed.where(F.col("n_tokens") <= F.col("mean")).withColumn("k", F.row_number().over(near)).where(F.col("k") <= RESERVE)
    placed = cut(placed.join(short.select("source", "id").distinct().withColumn("reserve", F.lit(True)), ["source", "id"], "left"), "placed")
    placed = placed.withColumn("reserve", F.coalesce("reserve", F.lit(False)))
    held = placed.where("reserve").select("id", "source", "n_tokens", "p")
    block = F.pmod(F.xxhash64(F.lit(seed), "id"), F.col("blocks"))
    flown = placed.where("not reserve").withColumn("block", block).groupBy("source", "block").applyInPandas(_fly(seed, False), schema)
    flown = cut(flown, "flown")
    undecided = f"p > {EPS} and p < {1 - EPS}"
    open_, settled = flown.where(undecided), flown.where(f"not ({undecided})")
    most, level = max((r.n for r in sums), default=0) / BLOCK * 2.5 + 2, 1
    while most > BLOCK:
        groups = int(-(-most // BLOCK))
        again = open_.withColumn("block", F.pmod(F.xxhash64(F.lit(seed + level), "id"), F.lit(groups)))
        again = cut(again.groupBy("source", "block").applyInPandas(_fly(seed + level, False), schema), "flown")
        settled, open_ = settled.union(again.where(f"not ({undecided})")), again.where(undecided)
        most, level = most / BLOCK * 2.5 + 2, level + 1
    last = open_.withColumn("reserve", F.lit(False)).union(held.withColumn("reserve", F.lit(True)))
    chosen = settled.union(last.groupBy("source").applyInPandas(_fly(seed + level, True), schema))
    chosen = chosen.join(F.broadcast(use.select("source", F.floor(F.col("use") + EPS).alias("base"))), "source")
    out = chosen.withColumn("copies", (F.col("base") + F.round("p")).cast("int"))
    return out.where("copies > 0").select("id", "source", "n_tokens", "copies")


def shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: target_share, actual_share of the tokens, n_docs, n_copies, n_tokens and most_copies."""
    per = mixture.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum("copies").alias("n_copies"),
        F.sum(F.col("n_tokens") * F.col("copies")).alias("n_tokens"),
        F.max("copies").alias("most_copies"),
    )
    whole = per.agg(F.sum("n_tokens")).first()[0] or 1
    out = targets.select("source", "target_share", "max_repeats").join(per, "source", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_docs", "n_copies", "n_tokens", "most_copies")]
    return out.select("source", "target_share", "max_repeats", *zero, (F.coalesce("n_tokens", F.lit(0)) / whole).alias("actual_share"))
