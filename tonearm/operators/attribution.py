"""Contributions of training members to outputs: leave-one-out differences, roll-ups of scores, ensembles and kernels.

Scores are coordinate tables (query, train, score): a transpose is a renaming, an axis is a table joined on its index.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonearm.functions.arrays import doubles


def loss_differences(losses: DataFrame, model: str = "model_id", query: str = "query_id", loss: str = "loss") -> DataFrame:
    """(seller, query, loss_full, loss_without, a_star): what each model without a seller loses against model 0.

    Queries that model 0 lacks give no row. Model 0 has a row per query and is joined on it.
    """
    full = losses.where(F.col(model) == 0).select(F.col(query).alias("query"), F.col(loss).alias("loss_full"))
    others = losses.where(F.col(model) != 0).select(F.col(model).alias("seller"), F.col(query).alias("query"), F.col(loss).alias("loss_without"))
    return others.join(full, "query").select("seller", "query", "loss_full", "loss_without", (F.col("loss_without") - F.col("loss_full")).alias("a_star"))


def quality_differences(quality: DataFrame, seller: str = "seller", query: str = "query", q: str = "quality") -> DataFrame:
    """(seller, query, q_full, q_loo, a_star): quality with all less quality without the seller; the full one has seller 0."""
    full = quality.where(F.col(seller) == 0).select(F.col(query).alias("query"), F.col(q).alias("q_full"))
    loo = quality.where(F.col(seller) != 0).select(F.col(seller).alias("seller"), F.col(query).alias("query"), F.col(q).alias("q_loo"))
    return loo.join(full, "query").select("seller", "query", "q_full", "q_loo", (F.col("q_full") - F.col("q_loo")).alias("a_star"))


def leave_one_out_means(parts: DataFrame, seller: str, query: str, amount: str, count: str) -> DataFrame:
    """(seller, query, a_star): the mean without a seller less the mean of all, from per-seller sums and counts.

    One pass over the parts instead of one over the rows for each seller; null where a seller holds every row of a query.
    """
    whole = parts.groupBy(F.col(query).alias("query")).agg(F.sum(amount).alias("__a"), F.sum(count).alias("__n"))
    own = parts.select(F.col(seller).alias("seller"), F.col(query).alias("query"), F.col(amount).alias("__s"), F.col(count).alias("__c"))
    without = F.try_divide((F.col("__a") - F.col("__s")).cast("double"), F.col("__n") - F.col("__c"))
    return own.join(whole, "query").select("seller", "query", (without - F.col("__a").cast("double") / F.col("__n")).alias("a_star"))


def roll_up(scores: DataFrame, members: DataFrame, mean: bool = False) -> DataFrame:
    """(seller, query, value, n): scores (query, train, score) summed or averaged over each seller's members (seller, train).

    Sums are pre-aggregated before the shuffle, so a seller with most rows costs no task more. A train index listed twice
    for a seller counts twice; scores of no member are left out.
    """
    value = F.avg("score") if mean else F.sum("score")
    return scores.join(members, "train").groupBy("seller", "query").agg(value.alias("value"), F.count(F.lit(1)).alias("n"))


def signed_index_sums(lists: DataFrame, scores: DataFrame, sign: float = 1.0) -> DataFrame:
    """(seller, query, value): scores (train, query, score) summed over the indices of each seller's blank-separated list."""
    indices = F.filter(F.split(F.trim("train_indices"), r"\s+"), lambda x: x != "")
    one = lists.select("seller", F.explode(F.transform(indices, lambda x: x.cast("bigint"))).alias("train"))
    return one.join(scores, "train").groupBy("seller", "query").agg((F.lit(sign) * F.sum("score")).alias("value"))


def complete_grid(rows: DataFrame, few: DataFrame, block: int = 100_000) -> DataFrame:
    """Every row of rows with every row of few, as the complete grid is by its nature.

    few is counted and broadcast in blocks of at most about block rows; the rows stay where they are, so the grid is as evenly
    spread as they are.
    """
    blocks = max(1, -(-few.count() // block))
    left = rows.withColumn("__grid", F.lit(1))
    out = None
    for i in range(blocks):
        some = few if blocks == 1 else few.where(F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in few.columns)), F.lit(blocks)) == i)
        one = left.join(F.broadcast(some.withColumn("__grid", F.lit(1))), "__grid").drop("__grid")
        out = one if out is None else out.unionByName(one)
    return out


def subset_sums(scores: DataFrame, membership: DataFrame, excluded: bool = False) -> DataFrame:
    """(model, query, value): scores (query, train, score) summed over each model's subset (model, train), or over the rest.

    The rest is the total less the subset, never a pass of its own; a model without members has the whole, or no row.
    """
    inside = scores.join(membership, "train").groupBy("model", "query").agg(F.sum("score").alias("value"))
    if not excluded:
        return inside
    whole = scores.groupBy("query").agg(F.sum("score").alias("__t"))
    grid = complete_grid(whole, membership.select("model").distinct())
    return grid.join(inside, ["model", "query"], "left").select("model", "query", (F.col("__t") - F.coalesce("value", F.lit(0.0))).alias("value"))


def ensemble_mean(scores: DataFrame, keys: Sequence[str] = ("query", "train"), score: str = "score") -> DataFrame:
    """The mean over members in double, given as float, with the number of members."""
    value = F.avg(F.col(score).cast("double")).cast("float")
    return scores.groupBy(*keys).agg(value.alias(score), F.count(F.lit(1)).alias("n_members"))


def extremes(scores: DataFrame, query: str = "query", train: str = "train", score: str = "score") -> DataFrame:
    """Per query: the train ids of the largest and the smallest score (the lowest id of equals), mean and deviation."""
    s, t = F.col(score), F.col(train)
    top, low = F.struct(s, -t), F.struct(s, t)
    return scores.groupBy(F.col(query).alias("query")).agg(
        F.max_by(t, top).alias("most_id"),
        F.max(s).alias("most"),
        F.min_by(t, low).alias("least_id"),
        F.min(s).alias("least"),
        F.avg(s).alias("mean"),
        F.stddev_pop(s).alias("std"),
    )


def rows_of(column: pa.Array, d: int | None = None) -> np.ndarray:
    """A column of lists of doubles, none null, as a matrix of their first d values; lists of other lengths than the first are
    an error.
    """
    n = len(column)
    values = column.flatten().to_numpy(zero_copy_only=False)
    width = len(values) // n if n else d or 0
    if n and not pc.all(pc.equal(pc.list_value_length(column), width)).as_py():
        if d is None:
            raise ValueError("vectors of different lengths")
        return np.stack([np.asarray(v[:d], float) for v in column.to_pylist()])
    return np.asarray(values, float).reshape(n, width)[:, :d]


def gram(train: DataFrame, vector: str, d: int) -> np.ndarray:
    """The d x d matrix of inner products of the columns of all vectors, summed where the rows are."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for b in batches:
            if b.num_rows:
                x = rows_of(b.column(0), d)
                total += x.T @ x
        yield pa.RecordBatch.from_pydict({"i": np.repeat(np.arange(d), d), "j": np.tile(np.arange(d), d), "v": total.ravel()})

    cells = train.select(doubles(vector).alias("v")).where("v is not null").mapInArrow(part, "i bigint, j bigint, v double")
    out = np.zeros((d, d))
    for r in cells.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r.i, r.j] = r.v
    return out


def kernel_scores(
    train: DataFrame,
    queries: DataFrame,
    train_id: str,
    query_id: str,
    vector: str,
    d: int,
    ridge: float = 1e-3,
    negate: bool = False,
    block: int = 4096,
    most: int | None = None,
) -> DataFrame:
    """(query, train, score) with score = q (X'X + ridge I)^-1 x', or its negative, over the first d dimensions; of each query
    only the most largest if asked, of equals those of the higher train id.

    Only the d x d matrix is gathered and sent; the queries are a stated set that meets all train rows in blocks.
    """
    inverse = np.linalg.inv(gram(train, vector, d) + ridge * np.eye(d)) * (-1 if negate else 1)
    return gather_products(queries, train, query_id, train_id, vector, inverse, block, d, most)


def gather_products(
    queries: DataFrame,
    base: DataFrame,
    query_id: str,
    base_id: str,
    vector: str,
    matrix: np.ndarray | None = None,
    block: int = 4096,
    d: int | None = None,
    most: int | None = None,
) -> DataFrame:
    """(query, train, score): products q M x' of a stated set of queries with all base vectors; cosines without a matrix.

    The queries are sent in blocks of bounded size, each of which meets all base rows in one scan without a shuffle. most: only
    so many of the largest scores of each query, of which each task keeps no more than that. Null ids and vectors give no row.
    """
    spark = base.sparkSession
    asks = queries.select(F.col(query_id).cast("bigint").alias("q"), doubles(vector).alias("v")).where("q is not null and v is not null")
    rows = base.select(F.col(base_id).cast("bigint").alias("t"), doubles(vector).alias("v")).where("t is not null and v is not null")
    blocks = max(1, -(-asks.count() // block))
    plain = matrix is None
    out = None
    for i in range(blocks):
        part = asks.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i).collect()
        if not part:
            continue
        q = np.array([r.v[:d] for r in part])
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12) if plain else q @ matrix
        sent = spark.sparkContext.broadcast((np.array([r.q for r in part]), q))

        def products(batches: Iterator[pa.RecordBatch], q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for b in batches:
                for at in range(0, b.num_rows, 512):
                    some = b.slice(at, 512)
                    x = rows_of(some.column(1), d)
                    if plain:
                        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                    yield some.column(0).to_numpy(), q @ x.T

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            held_t, held_s = np.empty((len(ids), 0), np.int64), np.empty((len(ids), 0))
            for ts, s in products(batches, q):
                if most is None:
                    yield pa.RecordBatch.from_pydict({"query": np.repeat(ids, len(ts)), "train": np.tile(ts, len(ids)), "score": s.ravel()})
                    continue
                t = np.concatenate([held_t, np.broadcast_to(ts, s.shape)], axis=1)
                s = np.concatenate([held_s, s], axis=1)
                top = np.lexsort((-t, -s), axis=1)[:, :most]
                held_t, held_s = np.take_along_axis(t, top, 1), np.take_along_axis(s, top, 1)
            if most is not None:
                yield pa.RecordBatch.from_pydict({"query": np.repeat(ids, held_t.shape[1]), "train": held_t.ravel(), "score": held_s.ravel()})

        hits = rows.mapInArrow(scan, "query bigint, train bigint, score double")
        out = hits if out is None else out.union(hits)
    if out is None:
        return spark.createDataFrame([], "query bigint, train bigint, score double")
    if most is None:
        return out
    place = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("train").desc())
    return out.withColumn("__r", F.row_number().over(place)).where(F.col("__r") <= most).drop("__r")
