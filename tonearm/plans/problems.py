"""Queries of the general data problems: packed fields (1) and dominant keys (3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.functions.ids import digits_number
from tonearm.operators.packed import split_packed, with_values
from tonearm.operators.skew import dominant_keys, ordered_stats
from tonearm.plans.registry import core
from tonearm.session import table

ARTIST_NO = "TRY_CAST(nullif(regexp_replace(artist_id, '[^0-9]', '', 'g'), '') AS BIGINT)"
ALBUM_NO = "TRY_CAST(nullif(regexp_replace(album_id, '[^0-9]', '', 'g'), '') AS BIGINT)"


@core.add("p1_found")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per tag of autotagging.tags with its position in the field."""
    rows = table(spark, sf_dir, "autotagging").select("line_no", "tags")
    return split_packed(rows, "tags", position="tag_pos", value="tag").select("line_no", "tag_pos", "tag")


@core.add("p1_dictionary")
def p1_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each tag occurs, alone or in company, over the whole catalog."""
    rows = table(spark, sf_dir, "autotagging").select("line_no", "tags")
    held = with_values(rows, "tags").select("values")
    own = lambda v: F.filter("values", lambda x: x == v)
    last = lambda v: F.size("values") - F.array_position(F.reverse("values"), v) + 1
    each = F.transform(F.array_distinct("values"), lambda v: F.struct(v.alias("tag"), F.size(own(v)).alias("uses"), last(v).cast("int").alias("last")))
    return held.select(F.explode(each).alias("t")).groupBy(F.col("t.tag").alias("tag")).agg(
        F.sum("t.uses").alias("n_uses"), F.count(F.lit(1)).alias("n_rows"), F.max("t.last").alias("last_pos")
    )


@core.add(
    "p1_round_trip",
    """
    WITH e AS (SELECT event_id, ['genre---' || event_type, 'mood/theme---deep, slow | ' || (event_id % 5), 'it''s "' || (event_id % 3) || '"', 'genre---' || event_type] AS t FROM events WHERE event_type IS NOT NULL)
    SELECT event_id, CAST(unnest(range(1, 5)) AS INTEGER) AS tag_pos, unnest(t) AS tag FROM e
    """,
)
def p1_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags packed as JSON, as quoted values, and between tabs, where those that hold delimiters are quoted; split again."""
    k = F.col("event_id")
    text = lambda c: c.cast("string")
    genre = F.concat(F.lit("genre---"), F.col("event_type"))
    tags = F.array(genre, F.concat(F.lit("mood/theme---deep, slow | "), text(k % 5)), F.concat(F.lit("it's \""), text(k % 3), F.lit('"')), genre)
    quoted = lambda x: F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))
    json, quotes = F.to_json(tags), F.array_join(F.transform(tags, quoted), "; ")
    tabs = F.array_join(F.transform(tags, lambda x: F.when(F.contains(x, F.lit(",")), quoted(x)).otherwise(x)), "\t")
    packed = F.when(k % 3 == 0, json).when(k % 3 == 1, quotes).otherwise(tabs)
    e = table(spark, sf_dir, "events").where("event_type is not null").select("event_id", packed.alias("packed"))
    return split_packed(e, "packed", position="tag_pos", value="tag").select("event_id", "tag_pos", "tag")


@core.add(
    "p3_found",
    f"""
    WITH a AS (SELECT {ARTIST_NO} AS artist_no FROM autotagging)
    SELECT artist_no FROM a WHERE artist_no IS NOT NULL
    GROUP BY artist_no HAVING count(*) >= 0.02 * (SELECT count(*) FROM a)
    """,
)
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artists with at least 2 % of all rows."""
    rows = table(spark, sf_dir, "autotagging").select(digits_number("artist_id").alias("artist_no"), "line_no")
    return dominant_keys(rows, "artist_no", "line_no", 0.02).select("artist_no")


@core.add(
    "p3_artist_sequences",
    f"""
    WITH r AS (SELECT {ARTIST_NO} AS artist_no, {ALBUM_NO} AS album_no, line_no, duration FROM autotagging),
    s AS (SELECT *, lag(line_no) OVER w AS before, lag(album_no) OVER w AS album_before,
                 row_number() OVER w AS k FROM r
          WINDOW w AS (PARTITION BY artist_no ORDER BY line_no))
    SELECT artist_no, count(*) AS n_rows, min(line_no) AS first_line, max(line_no) AS last_line,
           max(line_no - before) AS max_gap,
           CAST(sum(CASE WHEN k > 1 AND album_no IS DISTINCT FROM album_before THEN 1 ELSE 0 END) AS BIGINT) AS n_album_changes,
           round(sum(CASE WHEN duration > 0 THEN CAST(round(duration * 10) AS BIGINT) END) / 10.0, 1) AS total_duration_s
    FROM s WHERE artist_no IS NOT NULL GROUP BY artist_no
    """,
)
def p3_artist_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per artist, in order of delivery: rows, first and last line, longest gap, album changes, time in seconds."""
    rows = table(spark, sf_dir, "autotagging").select(
        digits_number("artist_id").alias("artist_no"),
        digits_number("album_id").alias("album_no"),
        "line_no",
        F.when(F.col("duration") > 0, F.round(F.col("duration") * 10).cast("bigint")).alias("tenths"),
    )
    stats = ordered_stats(rows.where("artist_no is not null"), "artist_no", "line_no", "album_no", "tenths", chunk_rows=5_000)
    return stats.select(
        "artist_no",
        "n_rows",
        F.col("first_at").alias("first_line"),
        F.col("last_at").alias("last_line"),
        "max_gap",
        "n_changes",
        F.round(F.col("total_amount") / 10.0, 1).alias("total_duration_s"),
    ).withColumnRenamed("n_changes", "n_album_changes")
