"""Queries of problem 2: capping dominant artists and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.functions.ids import digits_number
from tonearm.llm.caps import Cap, group_sizes, nested_caps, quality_order
from tonearm.llm.queries import llm
from tonearm.session import table
from tonearm.storage import cut

_NO = "TRY_CAST(nullif(regexp_replace({}, '[^0-9]', '', 'g'), '') AS BIGINT)"
_LATEST = f"""
    r AS (SELECT {_NO.format("track_id")} AS track_no, {_NO.format("artist_id")} AS artist_no,
                 {_NO.format("album_id")} AS album_no, CASE WHEN quality >= 0 THEN quality END AS q, line_no FROM autotagging),
    t AS (SELECT * FROM r WHERE track_no IS NOT NULL QUALIFY row_number() OVER (PARTITION BY track_no ORDER BY line_no DESC) = 1)
"""


def latest_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each track the row delivered last: track_no, artist_no, album_no, quality."""
    rows = table(spark, sf_dir, "autotagging").select(
        digits_number("track_id").alias("track_no"),
        "line_no",
        digits_number("artist_id").alias("artist_no"),
        digits_number("album_id").alias("album_no"),
        "quality",
    )
    last = [F.max_by(c, "line_no").alias(c) for c in ("artist_no", "album_no", "quality")]
    return rows.where("track_no is not null").groupBy("track_no").agg(*last)


@llm.add(
    "p2_found",
    f"""
    WITH {_LATEST}
    SELECT artist_no, track_no FROM t WHERE artist_no IS NOT NULL
    QUALIFY count(*) OVER (PARTITION BY artist_no) > 25
        AND row_number() OVER (PARTITION BY artist_no ORDER BY q DESC NULLS LAST, track_no) <= 25
    """,
)
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 best tracks of every artist with more than 25."""
    tracks = cut(latest_tracks(spark, sf_dir).where("artist_no is not null").drop("album_no"), "tracks")
    kept = nested_caps(tracks, [Cap(["artist_no"], 25)], [quality_order("quality"), F.col("track_no").asc()])
    large = group_sizes(tracks, ["artist_no"]).where("n_group > 25")
    return kept.join(large, "artist_no", "left_semi").select("artist_no", "track_no")


@llm.add(
    "p2_nested_catalog",
    f"""
    WITH {_LATEST},
    a AS (SELECT * FROM t WHERE album_no IS NULL OR artist_no IS NULL UNION ALL
          SELECT * FROM (SELECT * FROM t WHERE album_no IS NOT NULL AND artist_no IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY artist_no, album_no ORDER BY q DESC NULLS LAST, track_no) <= 3)),
    b AS (SELECT * FROM a WHERE artist_no IS NULL UNION ALL
          SELECT * FROM (SELECT * FROM a WHERE artist_no IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY artist_no ORDER BY q DESC NULLS LAST, track_no) <=
                  greatest(1, CAST(floor(0.01 * (SELECT count(*) FROM t)) AS BIGINT))))
    SELECT track_no, artist_no, album_no FROM b
    """,
)
def p2_nested_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 3 tracks of an artist's album and 1 % of the catalog by one artist, the best by quality."""
    tracks = cut(latest_tracks(spark, sf_dir), "tracks")
    caps = [Cap(["artist_no", "album_no"], 3), Cap(["artist_no"], max_share=0.01)]
    kept = nested_caps(tracks, caps, [quality_order("quality"), F.col("track_no").asc()])
    return kept.select("track_no", "artist_no", "album_no")


_SOURCE = "nullif(regexp_replace(lower(trim(source)), '[- ]+', '_', 'g'), '')"


@llm.add(
    "p2_document_sources",
    f"""
    WITH d AS (SELECT doc_id, author, {_SOURCE} AS src, CAST(coalesce(length(text), 0) AS BIGINT) AS size FROM documents),
    a AS (SELECT * FROM d WHERE author IS NULL OR src IS NULL UNION ALL
          SELECT * FROM (SELECT * FROM d WHERE author IS NOT NULL AND src IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY src, author ORDER BY size DESC, doc_id) <= 5)),
    b AS (SELECT * FROM a WHERE src IS NULL UNION ALL
          SELECT * FROM (SELECT * FROM a WHERE src IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY src ORDER BY size DESC, doc_id) <=
                  greatest(1, CAST(floor(0.05 * (SELECT count(*) FROM d)) AS BIGINT))))
    SELECT doc_id, author, src, size FROM b
    """,
)
def p2_document_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 5 documents of an author within a source and 5 % of all documents from a source, the longest first."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "author", clean_source("source").alias("src"), F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("size")
    )
    return nested_caps(
        docs, [Cap(["src", "author"], 5), Cap(["src"], max_share=0.05)], [F.col("size").desc(), F.col("doc_id").asc()]
    )


@llm.add(
    "p2_three_levels",
    f"""
    WITH r AS (SELECT line_no, batch_id, {_NO.format("artist_id")} AS artist_no, {_NO.format("album_id")} AS album_no,
                      CASE WHEN quality >= 0 THEN quality END AS q FROM autotagging),
    a AS (SELECT *, batch_id IS NULL OR artist_no IS NULL OR album_no IS NULL AS out3, batch_id IS NULL OR artist_no IS NULL AS out2, batch_id IS NULL AS out1 FROM r),
    b AS (SELECT * FROM a QUALIFY out3 OR row_number() OVER (PARTITION BY batch_id, artist_no, album_no, out3 ORDER BY q DESC NULLS LAST, line_no) <= 2),
    c AS (SELECT * FROM b QUALIFY out2 OR row_number() OVER (PARTITION BY batch_id, artist_no, out2 ORDER BY q DESC NULLS LAST, line_no) <= 20),
    d AS (SELECT * FROM c QUALIFY out1 OR row_number() OVER (PARTITION BY batch_id, out1 ORDER BY q DESC NULLS LAST, line_no) <=
              greatest(1, CAST(floor(0.07 * (SELECT count(*) FROM r)) AS BIGINT)))
    SELECT line_no, batch_id, artist_no, album_no FROM d
    """,
)
def p2_three_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each batch at most 2 rows of an artist's album, 20 of an artist and 7 % of all rows, the best by quality."""
    rows = table(spark, sf_dir, "autotagging").select(
        "line_no", "batch_id", digits_number("artist_id").alias("artist_no"), digits_number("album_id").alias("album_no"), "quality"
    )
    caps = [Cap(["batch_id", "artist_no", "album_no"], 2), Cap(["batch_id", "artist_no"], 20), Cap(["batch_id"], max_share=0.07)]
    kept = nested_caps(rows, caps, [quality_order("quality"), F.col("line_no").asc()])
    return kept.select("line_no", "batch_id", "artist_no", "album_no")


def clean_source(c: str):
    """One spelling of a source: lower case, with underscores; blank is null."""
    clean = F.regexp_replace(F.lower(F.trim(F.col(c))), "[- ]+", "_")
    return F.when(clean != "", clean)
