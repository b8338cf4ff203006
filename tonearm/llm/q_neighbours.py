"""Queries of problem 4: the most similar tracks of every track."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.functions.ids import basename, first_number
from tonearm.llm.neighbours import exact_nearest, nearest
from tonearm.llm.queries import llm
from tonearm.session import table

_TRACKS = r"""
    v AS (SELECT coalesce(track_id, TRY_CAST(nullif(regexp_extract(regexp_extract(audio_path, '[^/]*$'), '[0-9]+'), '') AS BIGINT)) AS no,
                 caption_id, CAST(audio_embedding AS DOUBLE[]) AS e FROM clap_embeddings),
    ok AS (SELECT no, caption_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
           WHERE no IS NOT NULL AND len(e) = 64 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
    t AS (SELECT no, list_transform(e, lambda x: x / norm) AS u FROM ok WHERE norm > 0
          QUALIFY row_number() OVER (PARTITION BY no ORDER BY caption_id) = 1)
"""


def track_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """no, audio_embedding of every row that has a track number."""
    no = F.coalesce(F.col("track_id"), first_number(basename("audio_path")))
    return table(spark, sf_dir, "clap_embeddings").select(no.alias("no"), "audio_embedding").where("no is not null")


@llm.add(
    "p4_found",
    f"""
    WITH {_TRACKS},
    p AS (SELECT a.no AS a, b.no AS b, list_dot_product(a.u, b.u) AS c FROM t a JOIN t b ON a.no <> b.no),
    r AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY c DESC, b) <= 5)
    SELECT DISTINCT least(a, b) AS track_no_a, greatest(a, b) AS track_no_b FROM r WHERE c >= 0.9
    """,
)
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of tracks, one among the five most similar of the other, with a cosine of at least 0.9."""
    found = nearest(track_vectors(spark, sf_dir), "no", "audio_embedding", 64, 5, least=0.9)
    return found.select(F.least("id", "other").alias("track_no_a"), F.greatest("id", "other").alias("track_no_b")).distinct()


# What a perfect search gives; on the small tables, where most cells are probed, the search gives it too.
_NEAR = f"""
    {_TRACKS},
    p AS (SELECT a.no AS track_no, b.no AS near_no, round(list_dot_product(a.u, b.u), 6) AS cosine FROM t a JOIN t b ON a.no <> b.no AND a.no % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY track_no ORDER BY cosine DESC, near_no) AS rank FROM p)
"""


@llm.add("p4_nearest", f"WITH {_NEAR} SELECT track_no, near_no, CAST(rank AS INTEGER) AS rank, cosine FROM r WHERE rank <= 5")
def p4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar tracks of every track whose number is divisible by 50, among all tracks."""
    found = nearest(track_vectors(spark, sf_dir), "no", "audio_embedding", 64, 5, every=50)
    return found.select(F.col("id").alias("track_no"), F.col("other").alias("near_no"), "rank", F.round("cosine", 6).alias("cosine"))


@llm.add("p4_recall", f"WITH {_NEAR} SELECT track_no, count(*) AS n_true, count(*) AS n_found FROM r WHERE rank <= 5 GROUP BY track_no")
def p4_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the same tracks, how many of their five truly most similar tracks were found."""
    tracks = track_vectors(spark, sf_dir)
    found = nearest(tracks, "no", "audio_embedding", 64, 5, every=50).select("id", "other", F.lit(1).alias("hit"))
    true = exact_nearest(tracks, "no", "audio_embedding", 64, 5, every=50).select("id", "other")
    both = true.join(found, ["id", "other"], "left")
    return both.groupBy(F.col("id").alias("track_no")).agg(F.count(F.lit(1)).alias("n_true"), F.count("hit").alias("n_found"))


@llm.add("p4_recall_reached", "SELECT true AS reached")
def p4_recall_reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether at least nine tenths of the true neighbours were found."""
    both = p4_recall(spark, sf_dir).agg(F.sum("n_true").alias("t"), F.sum("n_found").alias("f"))
    return both.select((F.coalesce("f", F.lit(0)) >= 0.9 * F.coalesce("t", F.lit(0))).alias("reached"))
