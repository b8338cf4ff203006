"""Queries of problem 7: passages of evaluation items in documents."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.llm.leaks import find_leaks
from tonearm.llm.q_caps import clean_source
from tonearm.llm.queries import llm
from tonearm.llm.reading import words
from tonearm.session import table


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), "doc_id", "text", "item_id", "text")


@llm.add("p7_found")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with at least 12 consecutive words of an item, and the items."""
    return _leaks(spark, sf_dir).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


@llm.add("p7_report")
def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per suite and source: leaked items, documents concerned and pairs."""
    items = table(spark, sf_dir, "eval_items").select(F.col("item_id").alias("item"), "suite")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), clean_source("source").alias("source"))
    pairs = _leaks(spark, sf_dir).join(items, "item").join(docs, "doc")
    return pairs.groupBy("suite", "source").agg(
        F.count_distinct("item").alias("n_items"), F.count_distinct("doc").alias("n_docs"), F.count(F.lit(1)).alias("n_pairs")
    )


@llm.add("p7_verified", "SELECT CAST(0 AS BIGINT) AS n_without_a_shared_run")
def p7_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs found whose texts, read once more, don't share twelve consecutive words: none."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("text").alias("a"))
    i = table(spark, sf_dir, "eval_items").select(F.col("item_id").alias("item"), F.col("text").alias("b"))
    pairs = _leaks(spark, sf_dir).select("doc", "item").join(d, "doc").join(i, "item")

    @F.arrow_udf("boolean")
    def shared(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a.to_pylist(), b.to_pylist()):
            runs = [{tuple(w[j : j + 12]) for j in range(len(w) - 11)} for w in (words(x), words(y))]
            out.append(not runs[0].isdisjoint(runs[1]))
        return pa.array(out)

    return pairs.agg(F.count(F.when(~shared("a", "b"), 1)).alias("n_without_a_shared_run"))
