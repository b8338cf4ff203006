"""Queries of problem 9: oversized documents in pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonearm.llm.chunking import split_items, with_pieces
from tonearm.llm.queries import llm
from tonearm.session import table

LIMIT, OVERLAP = 1024, 64


@llm.add("p9_found")
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of more than 1,024 tokens: those that were cut."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_pieces(docs, "text", LIMIT, OVERLAP).where(F.size("pieces") > 1).select("doc_id")


@llm.add("p9_pieces")
def p9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in pieces of at most 1,024 tokens that overlap by up to 64."""
    return split_items(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", LIMIT, OVERLAP, count_short=True)


@llm.add("p9_checked", "SELECT doc_id, CAST(length(text) AS INTEGER) AS covered, true AS fits, true AS joined FROM documents WHERE text IS NOT NULL")
def p9_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: characters up to which its pieces cover it, whether all fit, and whether none begins after the end of the
    one before it or more than the overlap's tokens before it.
    """
    pieces = p9_pieces(spark, sf_dir)
    before = Window.partitionBy("doc_id").orderBy("piece_no")
    pieces = pieces.withColumn("gap", F.col("start") - F.lag("stop", 1, 0).over(before))
    return pieces.groupBy("doc_id").agg(
        F.max("stop").alias("covered"), F.min(F.coalesce("n_tokens", F.lit(LIMIT + 1)) <= LIMIT).alias("fits"), (F.max("gap") <= 0).alias("joined")
    )
