"""Queries of problem 8: documents mixed to target shares of tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.llm.chunking import count_tokens
from tonearm.llm.mixing import mix, shares
from tonearm.llm.q_caps import clean_source
from tonearm.llm.queries import llm
from tonearm.session import table
from tonearm.storage import cut


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", clean_source("source").alias("source"), "text")
    sized = count_tokens(docs.where("source is not null"), "text").select(F.col("doc_id").alias("id"), "source", "n_tokens")
    targets = table(spark, sf_dir, "mix_targets")
    return mix(sized, targets), targets


@llm.add("p8_mixture")
def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture with their number of copies."""
    return _mixture(spark, sf_dir)[0].withColumnRenamed("id", "doc_id")


@llm.add("p8_shares")
def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source."""
    return shares(*_mixture(spark, sf_dir))


@llm.add("p8_shares_met", "SELECT source, true AS share_met, true AS repeats_kept FROM mix_targets")
def p8_shares_met(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source whether its share is the target's, to a hundredth and the longest document, and its repeats are allowed."""
    mixture, targets = _mixture(spark, sf_dir)
    size = mixture.agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("t"), F.max("n_tokens").alias("m")).first()
    slack = 0.01 + (size.m or 0) / max(size.t or 0, 1)
    near = F.abs(F.col("actual_share") - F.col("target_share")) <= slack
    return shares(mixture, targets).select("source", near.alias("share_met"), (F.col("most_copies") <= F.col("max_repeats")).alias("repeats_kept"))


@llm.add("p8_shortage", "SELECT source, true AS kept FROM mix_targets")
def p8_shortage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mixture of twice the tokens there are: sources too small for it are used max_repeats times and no more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", clean_source("source").alias("source"), "text")
    sized = count_tokens(docs.where("source is not null"), "text").select(F.col("doc_id").alias("id"), "source", "n_tokens")
    sized, targets = cut(sized, "sized"), table(spark, sf_dir, "mix_targets")
    total = 2.0 * (sized.agg(F.sum("n_tokens")).first()[0] or 0)
    held = sized.where("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("held"), F.max("n_tokens").alias("longest"))
    got = shares(mix(sized, targets, total), targets).join(held, "source", "left")
    there = got.where("held > 0").agg(F.sum("target_share")).first()[0] or 1.0  # shares are those of the sources that are there
    want = F.least(F.col("target_share") / there * total, F.col("max_repeats") * F.coalesce("held", F.lit(0)))
    kept = (F.col("most_copies") <= F.col("max_repeats")) & (F.abs(F.col("n_tokens") - want) <= F.coalesce("longest", F.lit(0)) + 1)
    return got.select("source", kept.alias("kept"))
