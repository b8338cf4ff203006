"""Base tables of the queries, in Spark and as SQL: the roles that the test tables play.

Line items are training members: the supplier is the seller, the month of shipping the query, the amount a score. Events
are catalog rows: the user is the artist, the type the genre. Amounts are whole cents, so that sums don't depend on order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.operators.attribution import leave_one_out_means
from tonearm.session import table


def nn(sql: str) -> str:
    """SQL that is null where the expression isn't finite."""
    return f"(CASE WHEN isfinite({sql}) THEN {sql} END)"


SCORES = """
    sc AS (SELECT l_suppkey AS seller, CAST(month(l_shipdate) AS INTEGER) AS query, l_orderkey * 8 + l_linenumber AS train,
                  CAST(floor(l_extendedprice * (1 - l_discount) * 100 + 0.5) AS BIGINT) AS cents, CAST(l_quantity AS BIGINT) AS qty
           FROM lineitem)
"""

PAIRS = f"""
    {SCORES},
    pp AS (SELECT seller, query, CAST(sum(cents) AS BIGINT) AS cents, CAST(sum(qty) AS BIGINT) AS qty, count(*) AS n FROM sc GROUP BY seller, query),
    pt AS (SELECT query, CAST(sum(qty) AS BIGINT) AS qty, CAST(sum(n) AS BIGINT) AS n FROM pp GROUP BY query),
    pairs AS (SELECT seller, query, CAST(pp.cents AS DOUBLE) / 1e8 AS hat,
                     (CAST(pt.qty - pp.qty AS DOUBLE) / nullif(pt.n - pp.n, 0) - CAST(pt.qty AS DOUBLE) / pt.n) * 1000 AS star
              FROM pp JOIN pt USING (query))
"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seller, query, train, cents, qty of every line item."""
    cents = F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100 + 0.5)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("seller"),
        F.month("l_shipdate").alias("query"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("train"),
        cents.alias("cents"),
        F.col("l_quantity").cast("bigint").alias("qty"),
    )


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cents, qty and n of each seller and query."""
    return scores(spark, sf_dir).groupBy("seller", "query").agg(F.sum("cents").alias("cents"), F.sum("qty").alias("qty"), F.count(F.lit(1)).alias("n"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seller, query, hat (its score in the query) and star (what leaving it out changes), scaled to about 1."""
    p = parts(spark, sf_dir)
    star = leave_one_out_means(p, "seller", "query", "qty", "n")
    return p.join(star, ["seller", "query"]).select("seller", "query", (F.col("cents").cast("double") / 1e8).alias("hat"), (F.col("a_star") * 1000).alias("star"))


CATALOG = """
    cat AS (SELECT event_id AS row_no, user_id AS artist, CAST(ts AS DATE) AS album, event_type AS genre,
                   CAST(floor(value * 100 + 0.5) AS BIGINT) AS duration FROM events)
"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_no, artist, album, genre, duration (in hundredths) of every event."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_no"),
        F.col("user_id").alias("artist"),
        F.col("ts").cast("date").alias("album"),
        F.col("event_type").alias("genre"),
        F.floor(F.col("value") * 100 + 0.5).alias("duration"),
    )


ARTISTS = f"""
    {CATALOG},
    gc AS (SELECT artist, genre, count(*) AS c, min(row_no) AS f FROM cat WHERE genre IS NOT NULL GROUP BY artist, genre),
    gm AS (SELECT artist, arg_min(genre, (-c, f)) AS primary_genre, max(c) / CAST(sum(c) AS DOUBLE) AS coherence, count(*) AS n_genres FROM gc GROUP BY artist),
    ar AS (SELECT cat.artist, count(*) AS n_tracks, CAST(sum(duration) AS BIGINT) AS total_duration, count(DISTINCT album) AS n_albums FROM cat GROUP BY cat.artist),
    artists AS (SELECT ar.artist, n_tracks, total_duration, n_albums, coalesce(primary_genre, 'unknown') AS primary_genre,
                       coalesce(coherence, 0) AS coherence, coalesce(n_genres, 0) AS n_genres FROM ar LEFT JOIN gm ON ar.artist IS NOT DISTINCT FROM gm.artist)
"""


def artists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """artist, n_tracks, total_duration, n_albums, primary_genre, coherence, n_genres."""
    from tonearm.operators.catalog import contributor_summary

    c = catalog(spark, sf_dir)
    out = contributor_summary(c, c, "artist", "album", "duration", "genre", ["row_no"])
    return out.select(
        "artist",
        "n_tracks",
        F.col("total_duration_s").alias("total_duration"),
        "n_albums",
        "primary_genre",
        F.col("genre_coherence").alias("coherence"),
        F.col("n_unique_genres").cast("bigint").alias("n_genres"),
    )


EMB = """
    emb AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS norm FROM embeddings),
    u AS (SELECT vec_id, label, list_transform(e, lambda x: x / greatest(norm, 1e-12)) AS v FROM emb)
"""


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, embedding."""
    return table(spark, sf_dir, "embeddings")


SEQUENCE = """
    sq AS (SELECT user_id AS piece, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, event_id, value FROM events WHERE user_id IS NOT NULL),
    tok AS (SELECT piece, CAST(i AS INTEGER) AS i, event_id,
                   CASE WHEN event_id % 11 = 3 THEN 27512 ELSE 11000 + 128 * CAST(event_id % 129 AS INTEGER) + CAST((event_id * 7) % 128 AS INTEGER) END AS note0,
                   CASE WHEN event_id % 11 = 3 THEN 10000 ELSE 10000 + CAST(floor(abs(value)) AS INTEGER) % 1000 END AS dur0,
                   CAST(i * 40 + event_id % 30 AS INTEGER) AS time0,
                   CASE WHEN event_id % 5 = 0 AND event_id % 11 <> 3 THEN 27513 ELSE 0 END AS raise FROM sq),
    ev AS (SELECT piece, i, CAST(time0 + raise AS INTEGER) AS time, CAST(dur0 + raise AS INTEGER) AS dur, CAST(note0 + raise AS INTEGER) AS note, raise > 0 AS control FROM tok)
"""


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """piece and its events, an array of triples in order of time, with rests and controls among them."""
    from pyspark.sql import Window

    from tonearm.operators.tokens import triple

    e = table(spark, sf_dir, "events").where("user_id is not null")
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    rows = e.select(F.col("user_id").alias("piece"), i.alias("i"), "event_id", "value")
    k = F.col("event_id")
    rest = k % 11 == 3
    note = F.when(rest, 27512).otherwise(11000 + 128 * (k % 129) + (k * 7) % 128)
    dur = F.when(rest, 10000).otherwise(10000 + F.floor(F.abs("value")) % 1000)
    up = F.when((k % 5 == 0) & ~rest, 27513).otherwise(0)
    rows = rows.select("piece", "i", triple(F.col("i") * 40 + k % 30 + up, dur + up, note + up).alias("e"))
    lists = rows.groupBy("piece").agg(F.array_sort(F.collect_list(F.struct("i", "e"))).alias("s"))
    return lists.select("piece", F.transform("s", lambda s: s["e"]).alias("events"))
