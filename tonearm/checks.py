"""Assertions on tables before a query uses them; each is one small job and raises ValueError."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """df, if it has the columns."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"columns {missing} are missing")
    return df


def require_header(line: str, names: Sequence[str], sep: str = "\t") -> None:
    """The first fields of a header line must be names."""
    if line.rstrip("\r\n").split(sep)[: len(names)] != list(names):
        raise ValueError(f"unexpected header {line[:200]!r}")


def require_same_rows(a: DataFrame, b: DataFrame) -> None:
    """Both must have as many rows."""
    if (n := a.count()) != (m := b.count()):
        raise ValueError(f"{n} and {m} rows")


def require_range(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """df, if low <= column < high in all rows."""
    if not df.where((F.col(column) < low) | (F.col(column) >= high)).isEmpty():
        raise ValueError(f"{column} isn't within [{low}, {high})")
    return df


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df, if no two rows share the keys."""
    if not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"{list(keys)} repeat")
    return df


def require_same_axis(members: DataFrame, member: str, index: str, key: str) -> DataFrame:
    """members, if every index has one key in all members."""
    if not members.groupBy(index).agg(F.count_distinct(key).alias("n")).where("n > 1").isEmpty():
        raise ValueError(f"members disagree on {key}")
    return members
