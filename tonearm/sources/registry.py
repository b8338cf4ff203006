"""Sources by type, caches that know what they were made of, feature blocks, and user functions on rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.sources import files

Loader = Callable[[SparkSession, dict[str, Any]], DataFrame]
LOADERS: dict[str, Loader] = {}


def loader(*kinds: str) -> Callable[[Loader], Loader]:
    """Registers a loader for types of sources."""

    def keep(f: Loader) -> Loader:
        LOADERS.update(dict.fromkeys(kinds, f))
        return f

    return keep


def load(spark: SparkSession, spec: dict[str, Any]) -> DataFrame:
    """The table of a source by its dataset_type; an unknown type is an error."""
    kind = spec.get("dataset_type")
    if kind not in LOADERS:
        raise ValueError(f"unknown source type {kind!r}; known are {sorted(LOADERS)}")
    return LOADERS[kind](spark, spec)


@loader("audio_dir")
def _audio(spark: SparkSession, spec: dict[str, Any]) -> DataFrame:
    return files.scan_roots(spark, [d["path"] for d in spec["datasets"]], spec.get("extensions", files.AUDIO))


@loader("pre_encoded")
def _encoded(spark: SparkSession, spec: dict[str, Any]) -> DataFrame:
    out = None
    for d in spec["datasets"]:
        one = files.latents(spark, d["path"], spec.get("extensions", [".npy"]))
        out = one if out is None else out.union(one)
    return out


@loader("s3", "wds")
def _shards(spark: SparkSession, spec: dict[str, Any]) -> DataFrame:
    out = None
    for d in spec["datasets"]:
        one = files.members(spark, d["path"])
        out = one if out is None else out.union(one)
    return out


@loader("parquet", "orc", "json", "csv")
def _tables(spark: SparkSession, spec: dict[str, Any]) -> DataFrame:
    reader = spark.read.format(spec["dataset_type"]).options(**spec.get("options", {}))
    return (reader.schema(spec["schema"]) if spec.get("schema") else reader).load([d["path"] for d in spec["datasets"]])


def cached(spark: SparkSession, path: str, made_of: dict[str, str], make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path if it was made of the same (name, value) pairs; else make() is written there with them and read."""
    label = path.rstrip("/") + "/_made_of"
    same = False
    if files.exists(spark, label + "/_SUCCESS"):
        same = {r.name: r.value for r in spark.read.parquet(label).collect()} == made_of
    if not same:
        # Overwriting deletes the old label with the data; the new one is written last, so data never stand under a wrong one.
        make().write.mode("overwrite").parquet(path)
        spark.createDataFrame(list(made_of.items()), "name string, value string").coalesce(1).write.parquet(label)
    return spark.read.parquet(path)


def feature_blocks(blocks: Sequence[tuple[DataFrame, int]], row: str = "row") -> DataFrame:
    """One axis of several feature blocks: of each only the rows below its number of valid ones, numbered on from the one before."""
    out, offset = None, 0
    for df, valid in blocks:
        one = df.where(F.col(row) < valid).withColumn(row, F.col(row) + offset)
        out = one if out is None else out.unionByName(one)
        offset += valid
    return out


def first_source(*makers: Callable[[], DataFrame | None]) -> DataFrame:
    """The first source that is there: makers return None if theirs isn't."""
    for make in makers:
        if (df := make()) is not None:
            return df
    raise ValueError("none of the sources is there")


MetadataFunction = Callable[[dict[str, Column]], dict[str, Column]]


def apply_metadata(
    df: DataFrame, function: MetadataFunction, reject: str = "__reject__", payload: str | None = None, prepare: Callable[[Column], Column] | None = None
) -> DataFrame:
    """df with the columns that a user function makes of its columns; rows for which its reject column is true are left out.

    A column of the function's replaces one of df. Its __replace__ stands for the payload column where it isn't null, and its
    __audio__, a dictionary of signals, gives a column each, made ready like the payload by prepare. Functions of columns stay
    in the JVM; a pandas_udf is a column as well.
    """
    made = function({c: F.col(c) for c in df.columns})
    veto, new, extra = made.pop(reject, None), made.pop("__replace__", None), made.pop("__audio__", {})
    if new is not None:
        if payload is None:
            raise ValueError("a replacement needs the payload's column")
        made[payload] = F.coalesce(new, F.col(payload))
    made |= {name: prepare(signal) if prepare else signal for name, signal in extra.items()}
    if veto is None:
        return df.withColumns(made)
    return df.withColumns({**made, reject: F.coalesce(veto, F.lit(False))}).where(~F.col(f"`{reject}`")).drop(reject)


def converted(df: DataFrame, converters: dict[str, Callable[[Column], Column]], defaults: dict[str, str] | None = None) -> DataFrame:
    """df with each converter's column made of the column of its name, or of its default's where that is null or missing."""
    out = {}
    for name, f in converters.items():
        own = F.col(name) if name in df.columns else F.lit(None)
        other = (defaults or {}).get(name)
        out[name] = f(F.coalesce(own, F.col(other)) if other else own)
    return df.withColumns(out)


METHODS: dict[str, tuple[str, str]] = {}


def method(name: str, table: str, column: str) -> None:
    """Registers where a method's scores stand."""
    METHODS[name] = (table, column)


def method_scores(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(seller_id, prompt_id, score) of a registered method, keys as text."""
    where, column = METHODS[name]
    rows = spark.read.parquet(f"{root}/{where}")
    return rows.select(F.col("seller_id").cast("string").alias("seller_id"), F.col("prompt_id").cast("string").alias("prompt_id"), F.col(column).alias("score"))
