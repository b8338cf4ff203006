"""Capping records per dominant contributor: nested caps as a laminar matroid.

Caps nest when each finer key includes the coarser one (author within domain within organisation). Sets that respect them
are the independent sets of a laminar matroid, for which keeping the best records greedily is optimal, and keeping the
best of each group from the finest level to the coarsest gives the same set. Each level is one ranked window pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonearm.operators.skew import number_rows

#: Up to this rank Spark keeps the best of each group in every map task, before anything is shuffled.
PUSHED_RANK = 900


@dataclass(frozen=True)
class Cap:
    """At most max_count records, and at most max_share (taken as the decimal it is written as) of all input records, at least
    one, for each value of keys.
    """

    keys: Sequence[str]
    max_count: int | None = None
    max_share: float | None = None

    def rows(self, total: int | None) -> int:
        """The cap in records."""
        given = [self.max_count] if self.max_count is not None else []
        if self.max_share is not None:
            given.append(max(1, int(Fraction(str(self.max_share)) * total)))
        if not given:
            raise ValueError("a cap needs max_count or max_share")
        return min(given)


def quality_order(quality: str) -> Column:
    """Best first; null, negative and NaN ratings come last, as equals."""
    q = F.col(quality)
    return F.when((q >= 0) & ~F.isnan(q.cast("double")), q).desc_nulls_last()


def nested_caps(df: DataFrame, caps: Sequence[Cap], order: Sequence[Column]) -> DataFrame:
    """The best rows of df, by order, that respect all caps; caps run from the finest level to the coarsest.

    A row with a null in a level's keys has no known contributor there and isn't limited by that level. Rows that tie in
    the order are chosen arbitrarily, so end the order with a unique column. Repeated rows count each. Caps of up to
    PUSHED_RANK rows prune every map task's groups before the shuffle; larger ones number the rows of each group exactly
    by offsets. In neither case does a task receive all rows of a hot group.
    """
    for finer, coarser in zip(caps, caps[1:]):
        if not set(coarser.keys) <= set(finer.keys):
            raise ValueError(f"caps don't nest: {list(coarser.keys)} isn't part of {list(finer.keys)}")
    if "__rank" in df.columns or "__alone" in df.columns:
        raise ValueError("columns __rank and __alone are used by the operator")
    total = df.count() if any(c.max_share is not None for c in caps) else None
    kept = df
    for cap in caps:
        limit = cap.rows(total)
        unknown = F.greatest(*(F.col(k).isNull() for k in cap.keys), F.lit(False))
        alone = kept.withColumn("__alone", F.when(unknown, F.monotonically_increasing_id()))
        if limit <= PUSHED_RANK:
            place = Window.partitionBy(*cap.keys, "__alone").orderBy(*order)
            ranked = alone.withColumn("__rank", F.row_number().over(place))
        else:
            ranked = number_rows(alone, [*cap.keys, "__alone"], order, number="__rank")
        kept = ranked.where(F.col("__rank") <= limit).drop("__rank", "__alone")
    return kept


def group_sizes(df: DataFrame, keys: Sequence[str], name: str = "n_group") -> DataFrame:
    """Rows per key, summed in the map tasks first."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
