"""Rankings within queries: top and bottom, ranks aligned across queries, nucleus and top-k choice, empirical distribution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonearm.operators.skew import join_unique, number_rows
from tonearm.operators.stats import percentiles
from tonearm.storage import cut


def ranked_by_score(scores: DataFrame, query: str, train: str, score: str, most: int, name: str = "rank") -> DataFrame:
    """Each query's rows up to rank most, the highest score first, of equals the higher index; ranks from 0.

    Small limits are applied in the map tasks, before the shuffle.
    """
    place = Window.partitionBy(query).orderBy(F.col(score).desc(), F.col(train).desc())
    return scores.withColumn(name, F.row_number().over(place)).where(F.col(name) <= most).withColumn(name, F.col(name) - 1)


def by_rank(ranked: DataFrame, rank: str, value: str) -> DataFrame:
    """Per rank the mean and population deviation of a value across queries."""
    return ranked.groupBy(rank).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(F.lit(1)).alias("n"))


def samples(scores: DataFrame, query: str, train: str, score: str, n: int) -> DataFrame:
    """(query, kind, place, train, score): each query's n highest, n lowest and n nearest to the median; ties by index."""
    med = percentiles(scores, score, [0.5], [query]).select(query, F.get("p", 0).alias("__m"))
    near = scores.join(med, query)
    orders = {"top": [F.col(score).desc(), F.col(train)], "bottom": [F.col(score).asc(), F.col(train)], "middle": [F.abs(F.col(score) - F.col("__m")), F.col(train)]}
    out = None
    for kind, order in orders.items():
        source = near if kind == "middle" else scores
        one = source.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy(*order))).where(F.col("place") <= n)
        one = one.select(query, F.lit(kind).alias("kind"), "place", train, score)
        out = one if out is None else out.union(one)
    return out


def first_per_group(df: DataFrame, keys: Sequence[str], order: Column, values: Sequence[str]) -> DataFrame:
    """The values of each key's first row by the order (unique within the key), without a sort."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*values), order).alias("__r")).select(*keys, *(F.col(f"__r.{v}").alias(v) for v in values))


def last_per_group(df: DataFrame, keys: Sequence[str], order: Column, values: Sequence[str]) -> DataFrame:
    """The values of each key's last row by the order."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("__r")).select(*keys, *(F.col(f"__r.{v}").alias(v) for v in values))


def cap_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each key by the order."""
    place = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(place)).where(F.col("__r") <= k).drop("__r")


def empirical_cdf(df: DataFrame, value: str, name: str = "cdf") -> DataFrame:
    """(value, n, cdf): each different value, how often it occurs and the share of rows up to it.

    Equal rows of a sorted list would get rising shares; the last of them, given here, is the same for every order. The rows
    are numbered by range partitions and offsets, so that nothing runs through all of them in one task.
    """
    rows = df.where(F.col(value).isNotNull()).select(value).withColumn("__all", F.lit(0))
    per = number_rows(rows, ["__all"], [value], "__no").groupBy(value).agg(F.count(F.lit(1)).alias("n"), F.max("__no").alias("__upto"))
    per = cut(per, "counts")
    whole = per.agg(F.max("__upto")).first()[0] or 1
    return per.select(value, "n", (F.col("__upto") / whole).alias(name))


def nucleus(df: DataFrame, keys: Sequence[str], p: str, item: str, top_p: float) -> DataFrame:
    """The rows that top-p choice may draw: in falling order of p while the sum before a row is at most top_p; renormalised.

    Running sums are made by range partitions and offsets, so a query's rows needn't fit into one task.
    """
    rows = number_rows(df, keys, [F.col(p).desc(), item], "__no", running=[p])
    kept = cut(rows.where(F.col(f"__sum_{p}") - F.col(p) <= top_p).select(*df.columns), "nucleus")
    return _renormalised(kept, keys, p)


def _renormalised(kept: DataFrame, keys: Sequence[str], p: str) -> DataFrame:
    """kept with p as a share of its key's sum, which is summed in the map tasks first."""
    sums = kept.groupBy(*keys).agg(F.sum(p).alias("__s"))
    both = join_unique(kept, sums, keys, "inner", null_safe=True)
    return both.select(*kept.columns, (F.col(p) / F.col("__s")).alias("renormalised"))


def top_k_choice(df: DataFrame, keys: Sequence[str], p: str, k: int) -> DataFrame:
    """The rows whose p is at least the k-th largest of their key (all of equals), renormalised."""
    kept = df.withColumn("__r", F.rank().over(Window.partitionBy(*keys).orderBy(F.col(p).desc()))).where(F.col("__r") <= k).drop("__r")
    return _renormalised(cut(kept, "top"), keys, p)


def largest_gap(df: DataFrame, keys: Sequence[str], time: str, order: Sequence[str]) -> DataFrame:
    """Per key the largest step of time between neighbours in the order, the first counted from 0."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__g", F.col(time) - F.lag(time, 1, 0).over(w)).groupBy(*keys).agg(F.greatest(F.max("__g"), F.lit(0)).alias("max_gap"))
