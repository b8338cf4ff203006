"""Most similar vectors for every vector: a cell index with score-aware quantisation, four-bit scans and exact reranking.

Cells and codebooks are fitted on bounded samples; many cells are fitted in two levels, the second by the executors, and their
number grows with the rows. Each vector lies in the cell of its nearest centroid; its residual is cut
into subspaces of two dimensions, each coded in four bits. Codes and codebooks minimise the anisotropic loss, which weighs
the part of the error along the vector more than the rest, as it is this part that falsifies large inner products. A query
probes the cells with the most similar centroids, as many as a measured recall asks for: its table of 16 inner products per
subspace is read by the codes of the cell's vectors, sums rank them, and the best are reranked by exact cosine.

Equal directions are compared once, as a class. Cells are cut into blocks of bounded rows on both sides, so that no task gets
a whole cell however full it is. Nothing but the index, whose size is bounded by its parameters, is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonearm.operators.skew import join_unique, salted_join
from tonearm.storage import cut

#: Vectors that the first level and the codebooks are fitted on, rows a cell is made for, cells of an index, and of its
#: first level alone. Cells grow with the rows up to 2^18, which is the square root of 7 * 10^10, and take 64 MB then.
SAMPLE, CELL_ROWS, MOST_CELLS, FLAT = 65_536, 256, 1 << 18, 1024
#: Vectors of a parent that its cells are fitted on for each cell, and at most.
PER_CELL, PARENT_SAMPLE = 16, 65_536
#: Rows of a cell that one task compares; queries whose neighbours are searched exactly to choose the probes, and the share of
#: their neighbours that the probed cells must hold.
BLOCK, CHECKS, TARGET = 16_384, 512, 0.97
SUB, CODES = 2, 16


@dataclass
class Index:
    """centroids (cells, d); books (subspaces, 16, 2); eta, the weight of the error along a vector; for two levels the parents'
    centroids and where the cells of each begin.
    """

    centroids: np.ndarray
    books: np.ndarray
    eta: float
    parents: np.ndarray | None = None
    starts: np.ndarray | None = None

    def cells(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The probes best cells of each unit vector, best first; -1 where the parents searched have fewer."""
        probes = min(probes, len(self.centroids))
        if self.parents is None:
            return _largest(x @ self.centroids.T, probes)
        out = np.full((len(x), probes), -1)
        sizes = np.diff(self.starts)
        spread = min(len(self.parents), 8 + -(-4 * probes // max(1, int(sizes.mean()))))
        for a in range(0, len(x), 1024):
            part = x[a : a + 1024]
            near = _largest(part @ self.parents.T, spread)
            width = sizes[near]
            at = np.cumsum(width, axis=1) - width
            sim = np.full((len(part), int(width.sum(1).max())), -np.inf)
            who = np.full(sim.shape, -1)
            for parent in np.unique(near):
                row, slot = np.nonzero(near == parent)
                lo, n = self.starts[parent], sizes[parent]
                cols = at[row, slot][:, None] + np.arange(n)
                sim[row[:, None], cols] = part[row] @ self.centroids[lo : lo + n].T
                who[row[:, None], cols] = lo + np.arange(n)
            best = _largest(sim, min(probes, sim.shape[1]))
            out[a : a + 1024, : best.shape[1]] = np.take_along_axis(who, best, 1)
        return out

    def encode(self, x: np.ndarray, cell: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes (n, subspaces) of unit vectors by coordinate descent on the anisotropic loss."""
        r = (x - self.centroids[cell]).reshape(len(x), -1, SUB)
        u = x.reshape(len(x), -1, SUB)
        m = r.shape[1]
        rows = np.arange(len(x))
        plain, turned = [], []
        code = np.empty(r.shape[:2], np.int64)
        along = np.zeros(len(x))
        ru = (r * u).sum(2)
        for s in range(m):
            b = self.books[s]
            plain.append((b * b).sum(1) - 2 * r[:, s] @ b.T)
            turned.append(ru[:, s, None] - u[:, s] @ b.T)
            code[:, s] = plain[s].argmin(1)
            along += turned[s][rows, code[:, s]]
        for _ in range(sweeps):
            for s in range(m):
                other = along - turned[s][rows, code[:, s]]
                p = other[:, None] + turned[s]
                code[:, s] = (plain[s] + (self.eta - 1) * p * p).argmin(1)
                along = other + turned[s][rows, code[:, s]]
        return code

    def scan(self, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Approximate products (queries, vectors) of queries and residuals from packed codes, two of four bits a byte: for each
        subspace the queries' table of 16 products is read by the vectors' codes.
        """
        tables = np.einsum("qsd,scd->scq", queries.reshape(len(queries), -1, SUB), self.books).astype(np.float32)
        out = np.zeros((len(codes), len(queries)), np.float32)
        for b in range(codes.shape[1]):
            out += tables[2 * b][codes[:, b] & 15]
            out += tables[2 * b + 1][codes[:, b] >> 4]
        return out.T


def _largest(sim: np.ndarray, k: int) -> np.ndarray:
    """The places of the k largest values of each row, largest first."""
    part = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    return np.take_along_axis(part, np.argsort(-np.take_along_axis(sim, part, 1), axis=1, kind="stable"), 1)


def pack(code: np.ndarray) -> np.ndarray:
    """Bytes of two codes each: the even subspace in the low half."""
    return (code[:, 0::2] | (code[:, 1::2] << 4)).astype(np.uint8)


def _clusters(x: np.ndarray, cells: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Centroids of unit length of so many clusters of unit vectors."""
    c = x[rng.permutation(len(x))[:cells]].astype(np.float64)
    for _ in range(rounds):
        home = np.concatenate([(part @ c.T).argmax(1) for part in np.array_split(x, max(1, len(x) // 4096))])
        order = np.argsort(home, kind="stable")
        here, first = np.unique(home[order], return_index=True)
        total = x[rng.integers(0, len(x), cells)].astype(np.float64)
        total[here] = np.add.reduceat(x[order], first, axis=0)
        c = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)
    return c


def fit(x: np.ndarray, cells: int, seed: int = 0, threshold: float = 0.2, rounds: int = 8) -> Index:
    """An index of one level fitted on unit vectors; threshold is the cosine from which on products matter."""
    rng = np.random.default_rng(seed)
    c = _clusters(x, max(1, min(cells, len(x))), rng, rounds)
    return with_books(Index(c, np.zeros((x.shape[1] // SUB, CODES, SUB)), 1.0), x, threshold, rng)


def with_books(index: Index, x: np.ndarray, threshold: float, rng: np.random.Generator) -> Index:
    """The index with codebooks fitted on the residuals of unit vectors."""
    d = x.shape[1]
    index.eta = max((d - 1) * threshold**2 / (1 - threshold**2), 1.0)
    some = x[rng.permutation(len(x))[:8192]].astype(np.float64)
    home = index.cells(some, 1)[:, 0]
    r = (some - index.centroids[home]).reshape(len(some), -1, SUB)
    m = d // SUB
    books = np.empty((m, CODES, SUB))
    for s in range(m):
        b = r[rng.integers(0, len(r), CODES), s].copy()
        b += rng.normal(0, 1e-6, b.shape)
        for _ in range(6):
            near = ((r[:, s, None] - b[None]) ** 2).sum(-1).argmin(1)
            for k in range(CODES):
                if (near == k).any():
                    b[k] = r[near == k, s].mean(0)
        books[s] = b
    index.books = books
    for _ in range(2):
        code = index.encode(some, home, 1)
        index.books = _best_books(r, some, code, index.eta, books)
    return index


def _best_books(r: np.ndarray, x: np.ndarray, code: np.ndarray, eta: float, books: np.ndarray) -> np.ndarray:
    """The codebooks that minimise the anisotropic loss for given codes, by least squares."""
    n, m = code.shape
    size = m * CODES * SUB
    z = np.zeros((n, size), np.float32)
    place = (np.arange(m)[None] * CODES + code) * SUB
    for k in range(SUB):
        z[np.arange(n)[:, None], place + k] = x.reshape(n, m, SUB)[:, :, k]
    along = (r.reshape(n, -1) * x).sum(1)
    left = (eta - 1) * (z.T @ z).astype(np.float64)
    right = (eta - 1) * (z.T @ along.astype(np.float32)).astype(np.float64)
    counts, sums = np.zeros((m, CODES)), np.zeros((m, CODES, SUB))
    for s in range(m):
        np.add.at(counts[s], code[:, s], 1)
        np.add.at(sums[s], code[:, s], r[:, s])
    left[np.arange(size), np.arange(size)] += np.repeat(counts.ravel(), SUB) + 1e-3
    right += sums.ravel() + 1e-3 * books.ravel()
    return np.linalg.solve(left, right).reshape(m, CODES, SUB)


def _units(raws: list[bytes], d: int) -> np.ndarray:
    x = np.frombuffer(b"".join(raws), np.float32).reshape(-1, d).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def direction_classes(df: DataFrame, id_col: str, vector: str, d: int, keep: int) -> tuple[DataFrame, DataFrame]:
    """Members (id, cls) and classes (cls, vec, first) of equal directions, to five decimals of each component.

    cls is the smallest id of the class, first its keep smallest ids, vec the vector of the smallest as bytes. Vectors that
    are null, not d wide, all zero or not finite, and null ids, are left out. Of a repeated id the first row by bytes counts.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys, vecs = [], [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1)):
                if i is None or not v.is_valid or len(v) != d or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float32)
                norm = float(np.linalg.norm(x.astype(np.float64)))
                if not np.isfinite(norm) or norm == 0.0:
                    continue
                ids.append(i)
                keys.append(xxhash.xxh3_128_digest(np.round(x / norm * 1e5).astype(np.int32).tobytes()))
                vecs.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary())], ["id", "key", "vec"])

    source = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).alias("v"))
    one = source.mapInArrow(rows, "id bigint, key binary, vec binary")
    one = cut(one.groupBy("id").agg(F.min(F.struct("key", "vec")).alias("x")).select("id", "x.key", "x.vec"), "vectors")
    lowest = Window.partitionBy("key").orderBy("id")
    few = one.withColumn("k", F.row_number().over(lowest)).where(F.col("k") <= keep)
    classes = few.groupBy("key").agg(F.min("id").alias("cls"), F.min_by("vec", "id").alias("vec"), F.sort_array(F.collect_list("id")).alias("first"))
    classes = cut(classes, "classes")
    members = join_unique(one.select("id", "key"), classes.select("key", "cls"), "key", "inner").select("id", "cls")
    return cut(members, "members"), classes.select("cls", "vec", "first")


def _drawn(classes: DataFrame, n: int, wanted: float, seed: int) -> DataFrame:
    """About wanted of n classes, drawn by hash; all if there are fewer."""
    if n <= wanted:
        return classes
    return classes.where(F.pmod(F.xxhash64(F.lit(seed), "cls"), F.lit(1 << 30)) < int((1 << 30) * wanted / n))


def fit_on(classes: DataFrame, d: int, seed: int = 0, sample: int = SAMPLE, cell_rows: int = CELL_ROWS, threshold: float = 0.2) -> Index | None:
    """An index with a cell for every cell_rows classes, at most MOST_CELLS. Up to FLAT cells are fitted on about sample classes
    drawn by hash. Of more, that sample gives the parents, as many as the root of the cells, and the executors fit the cells
    of each parent on a larger sample of its own.
    """
    n = classes.count()
    if n == 0:
        return None
    raws = [r.vec for r in _drawn(classes, n, sample, seed).select("cls", "vec").orderBy("cls").limit(2 * sample).collect()]
    x = _units(raws, d)
    cells = min(MOST_CELLS, max(1, round(n / cell_rows)))
    if cells <= FLAT:
        return fit(x, cells, seed, threshold)
    rng = np.random.default_rng(seed)
    parents = _clusters(x, max(1, min(round(cells**0.5), len(x))), rng)
    spark = classes.sparkSession
    sent = spark.sparkContext.broadcast(parents)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = (_units(b.column(1).to_pylist(), d) @ sent.value.T).argmax(1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near.astype(np.int32))], ["cls", "vec", "parent"])

    some = _drawn(classes, n, PER_CELL * cells, seed + 1).select("cls", "vec").mapInArrow(home, "cls bigint, vec binary, parent int")
    some = cut(some, "sample")
    counts = {r.parent: r["count"] for r in some.groupBy("parent").count().collect()}
    whole = sum(counts.values())
    kids = {c: min(PARENT_SAMPLE // PER_CELL, max(1, round(cells * k / whole))) for c, k in counts.items()}
    most = F.array(*(F.lit(min(1.0, PARENT_SAMPLE / counts.get(c, 1))) for c in range(len(parents))))
    few = some.where(F.pmod(F.xxhash64(F.lit(seed + 2), "cls"), F.lit(1 << 30)) / float(1 << 30) < F.get(most, F.col("parent")))

    def fit_cells(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = _units(pdf.sort_values("cls")["vec"].tolist(), d)
        c = _clusters(own, min(kids[key[0]], len(own)), np.random.default_rng([seed, key[0]]))
        return pd.DataFrame({"parent": key[0], "c": [v.tobytes() for v in c.astype(np.float32)]})

    rows = few.groupBy("parent").applyInPandas(fit_cells, "parent int, c binary").collect()
    rows.sort(key=lambda r: r.parent)
    centres = _units([r.c for r in rows], d)
    kept, sizes = np.unique([r.parent for r in rows], return_counts=True)
    index = Index(centres.astype(np.float32), np.zeros((d // SUB, CODES, SUB)), 1.0, parents[kept].astype(np.float32), np.concatenate(([0], np.cumsum(sizes))))
    return with_books(index, x, threshold, rng)


def _assign(sent, d: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            x = _units(b.column(1).to_pylist(), d)
            cell = index.cells(x, 1)[:, 0]
            codes = pack(index.encode(x, cell))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(cell.astype(np.int32))], ["cls", "vec", "codes", "cell"])

    return rows


def _probe(sent, d: int, probes: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            cells = sent.value.cells(_units(b.column(1).to_pylist(), d), probes)
            row, slot = np.nonzero(cells >= 0)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(cells[row, slot].astype(np.int32))], ["q", "qv", "cell"])

    return rows


def measured_probes(coded: DataFrame, index: Index, d: int, k: int, n: int, seed: int = 0, target: float = TARGET) -> int:
    """The least number of probed cells in which the target share of the k nearest of about CHECKS drawn vectors lie; these
    neighbours are found by comparing the drawn vectors with all others, in one scan.
    """
    drawn = _drawn(coded, n, CHECKS, seed + 3).select("cls", "vec").orderBy("cls").limit(2 * CHECKS).collect()
    ids, q = np.array([r.cls for r in drawn]), _units([r.vec for r in drawn], d)
    sent = coded.sparkSession.sparkContext.broadcast((ids, q))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = sent.value
        held = [np.full((len(q), k), -2.0), np.full((len(q), k), -1)]
        for b in batches:
            if not b.num_rows:
                continue
            cos = q @ _units(b.column(1).to_pylist(), d).T
            cos[ids[:, None] == b.column(0).to_numpy()[None, :]] = -2.0
            cell = np.broadcast_to(b.column(2).to_numpy(), cos.shape)
            cos, cell = np.concatenate([held[0], cos], axis=1), np.concatenate([held[1], cell], axis=1)
            top = _largest(cos, k)
            held = [np.take_along_axis(cos, top, 1), np.take_along_axis(cell, top, 1)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(q)), k)), pa.array(held[0].ravel()), pa.array(held[1].ravel().astype(np.int64))], ["q", "cosine", "cell"]
        )

    best = Window.partitionBy("q").orderBy(F.desc("cosine"), "cell")
    met = coded.select("cls", "vec", "cell").mapInArrow(scan, "q bigint, cosine double, cell bigint").where("cell >= 0")
    true = met.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).collect()
    if not true:
        return 1
    order = index.cells(q, min(len(index.centroids), 4096))
    ranks = [int(at[0]) + 1 if len(at := np.flatnonzero(order[r.q] == r.cell)) else order.shape[1] for r in true]
    return int(np.quantile(ranks, target, method="higher"))


_FOUND = "q bigint, x bigint, cosine double"


def _search(sent, d: int, k: int, rerank: int, least: float):
    def met(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"q": np.empty(0, np.int64), "x": np.empty(0, np.int64), "cosine": np.empty(0)})
        if not len(left) or not len(right):
            return empty
        index, cell = sent.value, int(key[0])
        q, x = _units(left["qv"].tolist(), d), _units(right["xv"].tolist(), d)
        qs, xs = left["q"].to_numpy(), right["x"].to_numpy()
        codes = np.frombuffer(b"".join(right["xc"].tolist()), np.uint8).reshape(len(xs), -1)
        out = []
        for a in range(0, len(qs), 256):
            part, own = q[a : a + 256], qs[a : a + 256]
            score = index.scan(part, codes)
            score[own[:, None] == xs[None, :]] = -np.inf
            r = min(rerank, len(xs))
            best = np.argpartition(-score, r - 1, axis=1)[:, :r] if r < len(xs) else np.tile(np.arange(len(xs)), (len(part), 1))
            exact = np.einsum("qd,qrd->qr", part, x[best])
            exact[own[:, None] == xs[best]] = -np.inf
            top = np.argsort(-exact, axis=1, kind="stable")[:, :k]
            cos, who = np.take_along_axis(exact, top, 1), xs[np.take_along_axis(best, top, 1)]
            ok = cos >= least
            out.append(pd.DataFrame({"q": np.repeat(own, ok.sum(1)), "x": who[ok], "cosine": cos[ok]}))
        return pd.concat(out) if out else empty

    return met


def similar_classes(
    classes: DataFrame, index: Index, d: int, k: int, probes: int | None, rerank: int, least: float = -2.0, queries=None, seed: int = 0
) -> DataFrame:
    """(q, x, cosine): for each class the k most similar others with a cosine of at least least; queries: a Column that tells
    which classes ask, all by default. probes: cells to search, measured_probes() if None.
    """
    spark = classes.sparkSession
    sent = spark.sparkContext.broadcast(index)
    coded = cut(classes.select("cls", "vec").mapInArrow(_assign(sent, d), "cls bigint, vec binary, codes binary, cell int"), "coded")
    n = coded.count()
    if probes is None:
        probes = measured_probes(coded, index, d, k, n, seed)
    asking = (coded if queries is None else coded.where(queries)).select("cls", "vec")
    probe = lambda rows: rows.mapInArrow(_probe(sent, d, probes), "q bigint, qv binary, cell int")
    asks = probe(asking)
    base = coded.select(F.col("cls").alias("x"), F.col("vec").alias("xv"), F.col("codes").alias("xc"), "cell")
    per: dict[int, list[int]] = {}
    some, share = _drawn(asking, n, BLOCK, seed + 4), max(1.0, n / BLOCK)  # how often a cell is asked is estimated
    for side, rows, scale in ((0, probe(some), share), (1, base, 1.0)):
        for r in rows.groupBy("cell").count().where(F.col("count") * scale > BLOCK).collect():
            per.setdefault(r.cell, [1, 1])[side] = int(-(-r["count"] * scale // BLOCK))
    if per:  # only cells with more rows than a block on a side are cut
        table = F.broadcast(spark.createDataFrame([(c, *n) for c, n in per.items()], "cell int, qn int, xn int"))
        asks, base = (t.join(table, "cell", "left").fillna(1, ["qn", "xn"]) for t in (asks, base))
    else:
        asks, base = (t.withColumns({"qn": F.lit(1), "xn": F.lit(1)}) for t in (asks, base))
    asks = asks.select("cell", F.pmod(F.xxhash64("q"), F.col("qn")).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.col("xn") - 1)).alias("xb"), "q", "qv")
    base = base.select("cell", F.explode(F.sequence(F.lit(0), F.col("qn") - 1)).alias("qb"), F.pmod(F.xxhash64("x"), F.col("xn")).cast("int").alias("xb"), "x", "xv", "xc")
    keys = ["cell", "qb", "xb"]
    hits = asks.groupBy(*keys).cogroup(base.groupBy(*keys)).applyInPandas(_search(sent, d, k, rerank, least), _FOUND)
    best = Window.partitionBy("q").orderBy(F.desc("cosine"), "x")
    return hits.withColumn("__k", F.row_number().over(best)).where(F.col("__k") <= k).drop("__k")


def nearest(
    df: DataFrame, id_col: str, vector: str, d: int = 64, k: int = 5, probes: int | None = None, rerank: int = 48, least: float = -2.0, every: int = 1, seed: int = 0
) -> DataFrame:
    """(id, other, cosine, rank): for each id divisible by every, the k most similar other ids, best first, ties by number,
    with a cosine of at least least; searched approximately, cosines exact. probes: cells that each query searches; by default
    as many as a measurement on drawn vectors shows to hold TARGET of the true neighbours.

    Vectors that are null, not d wide, all zero or not finite have no neighbours and are none. Copies are neighbours of cosine
    1 of each other, of which the smallest ids are given. An empty df gives no row.
    """
    members, classes = direction_classes(df, id_col, vector, d, k + 1)
    index = fit_on(classes, d, seed)
    if index is None:
        return members.select("id", F.col("cls").alias("other"), F.lit(1.0).alias("cosine"), F.lit(1).alias("rank")).limit(0)
    asking = members.where(F.col("id") % every == 0)
    queries = None
    base = classes
    if every > 1:
        base = classes.join(asking.select("cls").distinct().withColumn("asks", F.lit(1)), "cls", "left")
        base = base.select("vec", "first", F.when(F.col("asks") == 1, F.col("cls")).otherwise(-F.col("cls") - 1).alias("cls"))
        queries = F.col("cls") >= 0
    found = similar_classes(base, index, d, k, probes, rerank, least, queries, seed)
    found = found.select("q", F.when(F.col("x") >= 0, F.col("x")).otherwise(-F.col("x") - 1).alias("x"), "cosine")
    others = found.join(classes.select(F.col("cls").alias("x"), "first"), "x").select(F.col("q").alias("cls"), "cosine", "first")
    own = classes.where(F.size("first") > 1).select("cls", F.lit(1.0).alias("cosine"), "first")
    lists = cut(others.union(own).select("cls", "cosine", F.explode("first").alias("other")), "lists")
    met = salted_join(asking, lists, "cls").where("other <> id")
    place = Window.partitionBy("id").orderBy(F.desc("cosine"), "other")
    return met.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("id", "other", "cosine", "rank")


def exact_nearest(df: DataFrame, id_col: str, vector: str, d: int = 64, k: int = 5, every: int = 50, block: int = 20_000) -> DataFrame:
    """The same by comparing the queries, in blocks, with all classes: the measure of recall."""
    members, classes = direction_classes(df, id_col, vector, d, k + 1)
    asking = members.where(F.col("id") % every == 0)
    asks = cut(asking.select("cls").distinct().join(classes.select("cls", "vec"), "cls"), "asks")
    blocks = max(1, -(-asks.count() // block))
    spark = df.sparkSession
    out = None
    for i in range(blocks):
        rows = asks.where(F.pmod(F.xxhash64("cls"), F.lit(blocks)) == i).collect()
        if not rows:
            continue
        sent = spark.sparkContext.broadcast((np.array([r.cls for r in rows]), _units([r.vec for r in rows], d)))

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            qs, q = sent.value
            for b in batches:
                if not b.num_rows:
                    continue
                xs, x = b.column(0).to_numpy(), _units(b.column(1).to_pylist(), d)
                cos = q @ x.T
                cos[qs[:, None] == xs[None, :]] = -np.inf
                n = min(k, len(xs))
                top = np.argsort(-cos, axis=1, kind="stable")[:, :n]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qs, n)), pa.array(xs[top].ravel()), pa.array(np.take_along_axis(cos, top, 1).ravel())], ["q", "x", "cosine"])

        hits = classes.select("cls", "vec").mapInArrow(scan, _FOUND)
        out = hits if out is None else out.union(hits)
    if out is None:
        return members.select("id", F.col("cls").alias("other"), F.lit(1.0).alias("cosine"), F.lit(1).alias("rank")).limit(0)
    best = Window.partitionBy("q").orderBy(F.desc("cosine"), "x")
    found = out.where("cosine > -2").withColumn("__k", F.row_number().over(best)).where(F.col("__k") <= k)
    others = found.join(classes.select(F.col("cls").alias("x"), "first"), "x").select(F.col("q").alias("cls"), "cosine", "first")
    own = classes.where(F.size("first") > 1).select("cls", F.lit(1.0).alias("cosine"), "first")
    lists = cut(others.union(own).select("cls", "cosine", F.explode("first").alias("other")), "lists")
    met = salted_join(asking, lists, "cls").where("other <> id")
    place = Window.partitionBy("id").orderBy(F.desc("cosine"), "other")
    return met.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("id", "other", "cosine", "rank")
