"""Matching rows by paths and prioritised keys: include and exclude lists, first hit in order of priority, set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonearm.functions.paths import entry_keys, normpath
from tonearm.operators.attribution import complete_grid


def clean_entries(lines: DataFrame, line: str) -> DataFrame:
    """One column entry: the normalised lines that are neither blank nor comments, each once."""
    t = F.trim(F.col(line))
    return lines.where((t != "") & ~F.startswith(t, F.lit("#"))).select(normpath(t).alias("entry")).distinct()


def listed_paths(files: DataFrame, path: str, entries: DataFrame, roots: Sequence[str] = (), cwd: str = "/") -> DataFrame:
    """The distinct paths of files that some entry names; none for no entries."""
    keys = files.select(F.col(path).alias("__path")).distinct().withColumn("entry", F.explode(entry_keys("__path", list(roots), cwd)))
    return keys.join(entries.select("entry").distinct(), "entry", "left_semi").select("__path").distinct()


def exclude(files: DataFrame, path: str, entries: DataFrame, roots: Sequence[str] = (), cwd: str = "/") -> DataFrame:
    """Files that no entry names, repeats kept; all files for no entries. A null path is named by nothing."""
    hit = listed_paths(files, path, entries, roots, cwd)
    return files.join(hit, F.col(path) == F.col("__path"), "left_anti")


def include(files: DataFrame, path: str, entries: DataFrame, roots: Sequence[str] = (), cwd: str = "/") -> DataFrame:
    """Files that an entry names, repeats kept; an empty list includes all files."""
    if entries.isEmpty():
        return files
    hit = listed_paths(files, path, entries, roots, cwd)
    return files.join(hit, F.col(path) == F.col("__path"), "left_semi")


def without_indices(df: DataFrame, index: str, dropped: DataFrame, name: str) -> DataFrame:
    """Rows whose index isn't among dropped; null indices stay. Repeats are kept, unlike with EXCEPT."""
    return df.join(dropped.select(F.col(name).alias("__d")).distinct(), F.col(index) == F.col("__d"), "left_anti")


def leave_one_out(rows: DataFrame, seller: str, sellers: DataFrame, number: str, model: str = "model_id") -> DataFrame:
    """For each seller number of sellers, as model, all rows but those whose seller it is; model 0 has all rows.

    The result has a row per model and kept row by its nature; the rows stay where they are, the models come in blocks.
    """
    models = sellers.select(F.col(number).alias(model)).union(sellers.sparkSession.range(1).select(F.lit(0).alias(model)))
    grid = complete_grid(rows, models)
    return grid.where(~F.col(seller).eqNullSafe(F.col(model)) | (F.col(model) == 0))


def priority_match(
    left: DataFrame,
    left_id: str,
    left_keys: Column,
    right: DataFrame,
    right_keys: Column,
    right_order: Sequence[Column],
    payload: Sequence[str],
    last_wins: bool = False,
) -> DataFrame:
    """(left_id, key_no, payload...) of the left rows that match: of a row's keys in order the first that any right row has;
    of the right rows with a key the first by right_order (or the last). left_id must be unique. Unmatched rows are left out;
    null keys match nothing.
    """
    build = right.select(F.struct(*payload).alias("__p"), F.struct(*right_order).alias("__o"), F.explode(right_keys).alias("__key"))
    pick = F.max_by if last_wins else F.min_by
    build = build.where("__key is not null").groupBy("__key").agg(pick("__p", "__o").alias("__p"))
    probe = left.select(left_id, F.posexplode(left_keys).alias("__no", "__key"))
    hits = probe.join(build, "__key").groupBy(left_id).agg(F.min_by(F.struct(F.col("__no"), F.col("__p")), "__no").alias("__h"))
    return hits.select(left_id, F.col("__h.__no").alias("key_no"), *(F.col(f"__h.__p.{c}").alias(c) for c in payload))


def require_all(df: DataFrame, value: str, expected: int) -> DataFrame:
    """df, or an error unless it has exactly expected different values."""
    got = df.select(value).distinct().count()
    if got != expected:
        raise ValueError(f"{got} different values of {value}, expected {expected}")
    return df


def require_single(df: DataFrame, value: str) -> DataFrame:
    """df, or an error if it has more than one value in the column."""
    if df.select(value).distinct().limit(2).count() > 1:
        raise ValueError(f"more than one value of {value}")
    return df


def override(base: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """base with the values of changes where its row (by keys, unique there) has them and they aren't null."""
    shared = [c for c in changes.columns if c in base.columns and c not in keys]
    new = changes.select(*keys, *(F.col(c).alias(f"__{c}") for c in shared))
    joined = base.join(new, list(keys), "left")
    return joined.select(*(F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in shared else F.col(c) for c in base.columns))


def reorder(df: DataFrame, index: str, order: DataFrame, at: str, old: str) -> DataFrame:
    """df with index replaced by its new place: order has (at, old), so an index may be dropped or taken more than once."""
    return df.join(order.select(F.col(at).alias("__at"), F.col(old).alias("__old")), F.col(index) == F.col("__old")).select(
        *(F.col("__at").alias(index) if c == index else F.col(c) for c in df.columns)
    )


def size_split(df: DataFrame, size: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """(used, skipped with a reason): rows up to the limit, and those over it; a null size is used."""
    over = F.coalesce(F.col(size) > limit, F.lit(False))
    return df.where(~over), df.where(over).withColumn("reason", F.concat(F.lit("larger than "), F.lit(str(limit))))


def gate_code(*gates: Column) -> Column:
    """0 if no gate holds, else the number of the first that does."""
    out = F.lit(0)
    for i, g in reversed(list(enumerate(gates, 1))):
        out = F.when(F.coalesce(g, F.lit(False)), i).otherwise(out)
    return out
