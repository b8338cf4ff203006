"""Layouts of several code books in one sequence: delayed, parallel, unrolled, coarse-first and grouped.

A layout is a table (step, book, frame); building a sequence and reverting it are joins on it, with a special code where the
layout has nothing. Step 0 holds nothing but special codes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.operators.attribution import complete_grid
from tonearm.operators.catalog import sequence_numbers


def _grid(spark: SparkSession, books: int, frames: int) -> DataFrame:
    cells = spark.range(books * frames).select((F.col("id") % books).cast("int").alias("book"), F.floor(F.col("id") / books).cast("int").alias("frame"))
    return cells


def delayed(spark: SparkSession, books: int, frames: int, delays: Sequence[int] | None = None, flatten_first: int = 0, empty_initial: int = 0) -> DataFrame:
    """Each book delayed by its own number of steps (0, 1, 2, ... by default). The first flatten_first frames come one code a
    step; empty_initial more steps stand empty at the start (the special step is left out if it is negative).
    """
    d = list(delays) if delays is not None else list(range(books))
    lag = F.element_at(F.array(*(F.lit(x) for x in d)), F.col("book") + 1)
    head = (1 if empty_initial >= 0 else 0) + max(empty_initial, 0)
    flat = min(flatten_first, frames)
    first = F.col("frame") * books + F.col("book")
    later = flat * books + F.col("frame") + lag - flatten_first
    step = F.lit(head) + F.when(F.col("frame") < flat, first).otherwise(later)
    return _grid(spark, books, frames).select(step.cast("int").alias("step"), "book", "frame")


def parallel(spark: SparkSession, books: int, frames: int, empty_initial: int = 0) -> DataFrame:
    """All books of a frame in one step."""
    return delayed(spark, books, frames, [0] * books, empty_initial=empty_initial)


def unrolled(spark: SparkSession, books: int, frames: int, flattening: Sequence[int] | None = None, delays: Sequence[int] | None = None) -> DataFrame:
    """The books of a frame spread over inner steps (one each by default); those of an inner step share a delay in frames.

    Steps are ordered by their delayed frame, empty ones before those with codes, then by frame and first book.
    """
    flat = list(flattening) if flattening is not None else list(range(books))
    lag = list(delays) if delays is not None else [0] * books
    by_step = {s: {lag[q] for q in range(books) if flat[q] == s} for s in flat}
    if any(len(d) > 1 for d in by_step.values()):
        raise ValueError("books of one inner step need one delay")
    inner, last = max(flat) + 1, frames + max(lag)
    of_step = F.array(*(F.array(*(F.lit(q) for q in range(books) if flat[q] == s)).cast("array<int>") for s in range(inner)))
    lag_of = F.array(*(F.lit(next(iter(by_step.get(s, {0})))) for s in range(inner)))
    cells = spark.range(last * inner).select(F.floor(F.col("id") / inner).cast("int").alias("frame"), (F.col("id") % inner).cast("int").alias("__s"))
    cells = cells.withColumns({"__books": F.get(of_step, F.col("__s")), "__at": F.col("frame") + F.get(lag_of, F.col("__s"))}).where(F.col("__at") < last)
    place = ["__at", F.size("__books") > 0, "frame", F.coalesce(F.get("__books", 0), F.col("__s"))]
    numbered = sequence_numbers(cells, place, "step").where(F.col("frame") < frames)
    return numbered.select((F.col("step") + 1).cast("int").alias("step"), F.explode("__books").alias("book"), "frame")


def coarse_first(spark: SparkSession, books: int, frames: int, delays: Sequence[int] | None = None) -> DataFrame:
    """The first book's frames one a step, then the other books, each delayed by its own number of steps."""
    d = [0, *(delays if delays is not None else [0] * (books - 1))]
    lag = F.element_at(F.array(*(F.lit(x) for x in d)), F.col("book") + 1)
    step = F.when(F.col("book") == 0, F.col("frame")).otherwise(frames + F.col("frame") + lag) + 1
    return _grid(spark, books, frames).select(step.cast("int").alias("step"), "book", "frame")


def grouped(spark: SparkSession, books: int, frames: int, group_by: int = 2) -> DataFrame:
    """Groups of books one after the other, each with all its frames, one code a step."""
    g = F.floor(F.col("book") / group_by)
    step = g * group_by * frames + F.col("frame") * group_by + F.col("book") % group_by + 1
    return _grid(spark, books, frames).select(step.cast("int").alias("step"), "book", "frame")


def length(layout: DataFrame) -> int:
    """Steps of a layout, step 0 included."""
    return (layout.agg(F.max("step")).first()[0] or 0) + 1


def build(codes: DataFrame, layout: DataFrame, books: int, special: int, steps: int | None = None) -> DataFrame:
    """(id, book, step, code) of codes (id, book, frame, code): every step of every book, the special code where nothing is."""
    n = steps or length(layout)
    ids = codes.select("id").distinct()
    grid = ids.withColumn("book", F.explode(F.sequence(F.lit(0), F.lit(books - 1)))).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    placed = codes.join(layout, ["book", "frame"]).select("id", "book", "step", "code")
    return grid.join(placed, ["id", "book", "step"], "left").select("id", "book", "step", F.coalesce("code", F.lit(special)).alias("code"))


def revert(sequence: DataFrame, layout: DataFrame, special: int, model_output: bool = False) -> DataFrame:
    """(id, book, frame, code) of a sequence (id, book, step, code); frames whose step is missing get the special code.

    model_output: the sequence has no step 0, so its steps count from the layout's step 1.
    """
    own = layout.withColumn("step", F.col("step") - 1) if model_output else layout
    ids = sequence.select("id").distinct()
    grid = complete_grid(ids, own)
    return grid.join(sequence, ["id", "book", "step"], "left").select("id", "book", "frame", F.coalesce("code", F.lit(special)).alias("code"))
