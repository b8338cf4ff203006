"""Queries of catalogs: A1, A2, A6, A9, A13, A15, A17, J3, O1-O8, P4-P6, R1-R8, S8-S14, W6-W10, W14 and the catalog as delivered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.functions.ids import digits_number
from tonearm.operators import catalog as ct
from tonearm.operators import ranking as rk
from tonearm.operators.packed import split_packed
from tonearm.operators.stats import percentiles
from tonearm.plans.bases import ARTISTS, CATALOG, artists, catalog
from tonearm.plans.registry import core
from tonearm.session import table

_ARTIST_COLUMNS = "artist, n_tracks, total_duration, n_albums, primary_genre, round(coherence, 8) AS coherence, n_genres"


@core.add("a01_contributor_summary", f"WITH {ARTISTS} SELECT {_ARTIST_COLUMNS} FROM artists")
def a01_contributor_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per artist: tracks, time, albums, primary genre, coherence, genres (A1, A2)."""
    return artists(spark, sf_dir).withColumn("coherence", F.round("coherence", 8))


@core.add("a01_delivered_catalog")
def a01_delivered_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over the catalog as delivered: packed tags, several spellings of ids, unusable durations."""
    rows = table(spark, sf_dir, "autotagging").select(
        "line_no",
        digits_number("artist_id").alias("artist_no"),
        digits_number("album_id").alias("album_no"),
        F.when(F.col("duration") > 0, F.col("duration")).alias("duration"),
        "tags",
    )
    tags = split_packed(rows, "tags", position="tag_pos", value="tag").where(F.startswith("tag", F.lit("genre---")))
    genres = tags.select("artist_no", "line_no", "tag_pos", F.regexp_replace("tag", "^genre---", "").alias("genre"))
    out = ct.contributor_summary(rows.drop("tags"), genres, "artist_no", "album_no", "duration", "genre", ["line_no", "tag_pos"])
    return out.where("artist_no is not null")


_DELIVERED = """
    d AS (SELECT line_no, TRY_CAST(nullif(regexp_replace(artist_id, '[^0-9]', '', 'g'), '') AS BIGINT) AS artist_no,
                 TRY_CAST(nullif(regexp_replace(album_id, '[^0-9]', '', 'g'), '') AS BIGINT) AS album_no,
                 CASE WHEN duration > 0 THEN CAST(round(duration * 10) AS BIGINT) END AS tenths, 'b' || (batch_id % 7) AS genre FROM autotagging),
    g AS (SELECT artist_no, genre, count(*) AS c, min(line_no) AS f FROM d WHERE genre IS NOT NULL GROUP BY artist_no, genre),
    m AS (SELECT artist_no, arg_min(genre, (-c, f)) AS primary_genre, max(c) / CAST(sum(c) AS DOUBLE) AS coherence, count(*) AS n_genres FROM g GROUP BY artist_no)
"""


@core.add(
    "a01_delivered_profile",
    f"""
    WITH {_DELIVERED}, r AS (SELECT artist_no, count(*) AS n_tracks, CAST(sum(tenths) AS BIGINT) AS tenths, count(DISTINCT album_no) AS n_albums FROM d GROUP BY artist_no)
    SELECT r.artist_no, n_tracks, tenths, n_albums, coalesce(primary_genre, 'unknown') AS primary_genre, round(coalesce(coherence, 0), 8) AS coherence, coalesce(n_genres, 0) AS n_genres
    FROM r LEFT JOIN m ON r.artist_no = m.artist_no WHERE r.artist_no IS NOT NULL
    """,
)
def a01_delivered_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of the catalog as delivered without its packed tags: several spellings of ids, unusable durations."""
    d = table(spark, sf_dir, "autotagging").select(
        "line_no",
        digits_number("artist_id").alias("artist_no"),
        digits_number("album_id").alias("album_no"),
        F.when(F.col("duration") > 0, F.round(F.col("duration") * 10).cast("bigint")).alias("tenths"),
        F.concat(F.lit("b"), (F.col("batch_id") % 7).cast("string")).alias("genre"),
    )
    out = ct.contributor_summary(d, d, "artist_no", "album_no", "tenths", "genre", ["line_no"]).where("artist_no is not null")
    return out.select(
        "artist_no",
        "n_tracks",
        F.col("total_duration_s").alias("tenths"),
        "n_albums",
        "primary_genre",
        F.round("genre_coherence", 8).alias("coherence"),
        F.col("n_unique_genres").cast("bigint").alias("n_genres"),
    )


@core.add(
    "a06_first_value",
    "SELECT user_id, arg_min(event_type, event_id) AS event_type, arg_min(value, event_id) AS value FROM events GROUP BY user_id",
)
def a06_first_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user."""
    return rk.first_per_group(table(spark, sf_dir, "events"), ["user_id"], F.col("event_id"), ["event_type", "value"])


@core.add(
    "a09_global_summary",
    f"""
    WITH {ARTISTS}
    SELECT count(*) AS n_artists, CAST(sum(n_tracks) AS BIGINT) AS n_tracks, round(avg(n_tracks), 6) AS mean, CAST(quantile_cont(n_tracks, 0.5) AS DOUBLE) AS median, max(n_tracks) AS most,
           CAST(quantile_cont(n_tracks, 0.25) AS DOUBLE) AS q25, CAST(quantile_cont(n_tracks, 0.75) AS DOUBLE) AS q75,
           round(CAST(quantile_cont(n_tracks, 1.0 / 3) AS DOUBLE), 6) AS q33, round(CAST(quantile_cont(n_tracks, 2.0 / 3) AS DOUBLE), 6) AS q66,
           round(avg(CASE WHEN n_tracks >= 60 THEN 1.0 ELSE 0.0 END), 6) AS share_60, round(avg(coherence), 6) AS coherence_mean FROM artists
    """,
)
def a09_global_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distribution of tracks per artist over the whole catalog."""
    n = F.col("n_tracks")
    a = artists(spark, sf_dir)
    base = a.agg(
        F.count(F.lit(1)).alias("n_artists"),
        F.sum(n).alias("n_tracks"),
        F.round(F.avg(n), 6).alias("mean"),
        F.max(n).alias("most"),
        F.round(F.avg((n >= 60).cast("double")), 6).alias("share_60"),
        F.round(F.avg("coherence"), 6).alias("coherence_mean"),
    )
    cuts = percentiles(a, "n_tracks", [0.5, 0.25, 0.75, 1 / 3, 2 / 3])
    named = cuts.select(*(F.round(F.get("p", i), 6).alias(c) for i, c in enumerate(("median", "q25", "q75", "q33", "q66"))))
    return base.withColumn("k", F.lit(1)).join(F.broadcast(named.withColumn("k", F.lit(1))), "k").drop("k")


@core.add("a13_top_counts", f"WITH {ARTISTS} SELECT primary_genre, count(*) AS n FROM artists GROUP BY primary_genre ORDER BY n DESC, primary_genre LIMIT 3")
def a13_top_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent primary genres."""
    return ct.top_counts(artists(spark, sf_dir), "primary_genre", 3)


@core.add(
    "a15_selection_summary",
    f"""
    WITH {ARTISTS}
    SELECT min(n_tracks) AS least, CAST(quantile_cont(n_tracks, 0.5) AS DOUBLE) AS median, max(n_tracks) AS most,
           count(CASE WHEN n_tracks < 60 THEN 1 END) AS band_low, count(CASE WHEN n_tracks BETWEEN 60 AND 70 THEN 1 END) AS band_mid,
           count(CASE WHEN n_tracks > 70 THEN 1 END) AS band_high, count(CASE WHEN primary_genre = 'unknown' THEN 1 END) AS n_without_genre FROM artists
    """,
)
def a15_selection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extremes, median, counts by band and what lacks a genre."""
    n = F.col("n_tracks")
    count = lambda c: F.count(F.when(c, 1))
    a = artists(spark, sf_dir)
    base = a.agg(
        F.min(n).alias("least"),
        F.max(n).alias("most"),
        count(n < 60).alias("band_low"),
        count(ct.within(n, 60, 70)).alias("band_mid"),
        count(n > 70).alias("band_high"),
        count(F.col("primary_genre") == "unknown").alias("n_without_genre"),
    )
    median = percentiles(a, "n_tracks", [0.5]).select(F.get("p", 0).alias("median"), F.lit(1).alias("k"))
    return base.withColumn("k", F.lit(1)).join(F.broadcast(median), "k").drop("k")


@core.add("a17_status_counts", "SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY 1, 2")
def a17_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress counters by state and kind."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n"))


@core.add("p04_threshold", f"WITH {ARTISTS} SELECT artist, n_tracks FROM artists WHERE n_tracks >= 60 AND coherence >= 0.25")
def p04_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artists with enough tracks and a coherent catalog."""
    return artists(spark, sf_dir).where("n_tracks >= 60 and coherence >= 0.25").select("artist", "n_tracks")


@core.add(
    "p05_open_ranges",
    f"""
    WITH {ARTISTS}, b(band, lo, hi) AS (VALUES ('low', 50, 60), ('mid', 61, 70), ('high', 71, NULL))
    SELECT band, artist, n_tracks FROM artists JOIN b ON n_tracks >= lo AND (hi IS NULL OR n_tracks <= hi)
    """,
)
def p05_open_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artists by bands, the last of which is open."""
    bands = [("low", 50, 60), ("mid", 61, 70), ("high", 71, None)]
    label = F.coalesce(*(F.when(ct.within("n_tracks", lo, hi), b) for b, lo, hi in bands))
    return artists(spark, sf_dir).withColumn("band", label).where("band is not null").select("band", "artist", "n_tracks")


_TIER = "CASE WHEN n_tracks <= q33 THEN 'low' WHEN n_tracks <= q66 THEN 'mid' ELSE 'high' END"
_TIERED = f"""
    {ARTISTS}, pool AS (SELECT * FROM artists WHERE n_tracks >= 5),
    qs AS (SELECT quantile_cont(n_tracks, 1.0 / 3) AS q33, quantile_cont(n_tracks, 2.0 / 3) AS q66 FROM pool),
    tiered AS (SELECT pool.*, {_TIER} AS tier FROM pool CROSS JOIN qs),
    med AS (SELECT tier, quantile_cont(n_tracks, 0.5) AS med FROM tiered GROUP BY tier),
    ranked AS (SELECT tiered.*, row_number() OVER (PARTITION BY tier ORDER BY abs(n_tracks - med), coherence DESC, n_tracks DESC, artist) AS place FROM tiered JOIN med USING (tier))
"""


def _tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.terciles(artists(spark, sf_dir).where("n_tracks >= 5"), "n_tracks")


def _ranked(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return ct.nearest_to_median(_tiered(spark, sf_dir), "tier", "n_tracks", [F.desc("coherence"), F.desc("n_tracks"), F.col("artist")], k)


@core.add("w06_terciles", f"WITH {_TIERED} SELECT artist, n_tracks, tier FROM tiered")
def w06_terciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers by right-closed thirds."""
    return ct.terciles(artists(spark, sf_dir).where("n_tracks >= 5"), "n_tracks").select("artist", "n_tracks", "tier")


@core.add(
    "w07_quartiles",
    f"""
    WITH {ARTISTS}, q AS (SELECT quantile_cont(n_tracks, 0.25) AS a, quantile_cont(n_tracks, 0.5) AS b, quantile_cont(n_tracks, 0.75) AS c FROM artists)
    SELECT artist, n_tracks, CASE WHEN n_tracks <= a THEN 'low' WHEN n_tracks <= b THEN 'mid' WHEN n_tracks <= c THEN 'high' ELSE 'extra_high' END AS band FROM artists CROSS JOIN q
    """,
)
def w07_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strata by quarters."""
    return ct.quartiles(artists(spark, sf_dir), "n_tracks").select("artist", "n_tracks", "band")


@core.add("w08_nearest_to_median", f"WITH {_TIERED} SELECT tier, place, artist, n_tracks FROM ranked WHERE place <= 5")
def w08_nearest_to_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five artists nearest to their tier's median."""
    return _ranked(spark, sf_dir, 5).select("tier", F.col("place").cast("bigint").alias("place"), "artist", "n_tracks")


_PICKS = f"""
    {_TIERED}, top AS (SELECT tier, place, artist, primary_genre FROM ranked WHERE place <= 5),
    p1 AS (SELECT * FROM top WHERE tier = 'low' ORDER BY place LIMIT 1),
    p2 AS (SELECT top.* FROM top WHERE tier = 'mid' ORDER BY primary_genre IN (SELECT primary_genre FROM p1), place LIMIT 1),
    p3 AS (SELECT top.* FROM top WHERE tier = 'high' ORDER BY primary_genre IN (SELECT primary_genre FROM p1 UNION SELECT primary_genre FROM p2), place LIMIT 1),
    picks AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3)
"""


@core.add("w09_diverse_picks", f"WITH {_PICKS} SELECT tier, artist, primary_genre FROM picks")
def w09_diverse_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pick a tier, of different genres where possible."""
    return ct.diverse_picks(_ranked(spark, sf_dir, 5), "tier", "place", "primary_genre").select("tier", "artist", "primary_genre")


_MEDIAN_PICKS = f"""
    {_TIERED}, all_ AS (SELECT tier, artist, n_tracks, coherence, primary_genre FROM ranked),
    p1 AS (SELECT *, 'low' AS t FROM all_ WHERE tier = 'low' ORDER BY abs(n_tracks - (SELECT quantile_cont(n_tracks, 0.5) FROM all_ WHERE tier = 'low')), coherence DESC, artist LIMIT 1),
    f2 AS (SELECT * FROM all_ WHERE tier = 'mid' AND primary_genre NOT IN (SELECT primary_genre FROM p1)),
    c2 AS (SELECT * FROM f2 UNION ALL SELECT * FROM all_ WHERE tier = 'mid' AND NOT EXISTS (SELECT 1 FROM f2)),
    p2 AS (SELECT *, 'mid' AS t FROM c2 ORDER BY abs(n_tracks - (SELECT quantile_cont(n_tracks, 0.5) FROM c2)), coherence DESC, artist LIMIT 1),
    f3 AS (SELECT * FROM all_ WHERE tier = 'high' AND primary_genre NOT IN (SELECT primary_genre FROM p1 UNION ALL SELECT primary_genre FROM p2)),
    c3 AS (SELECT * FROM f3 UNION ALL SELECT * FROM all_ WHERE tier = 'high' AND NOT EXISTS (SELECT 1 FROM f3)),
    p3 AS (SELECT *, 'high' AS t FROM c3 ORDER BY abs(n_tracks - (SELECT quantile_cont(n_tracks, 0.5) FROM c3)), coherence DESC, artist LIMIT 1)
"""


@core.add("w09_median_picks", f"WITH {_MEDIAN_PICKS} SELECT tier, artist, n_tracks, primary_genre FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3)")
def w09_median_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pick a tier, nearest to the median of those whose genre isn't taken."""
    pool = _tiered(spark, sf_dir)
    picks = ct.diverse_median_picks(pool, "tier", "n_tracks", "primary_genre", [F.col("coherence").desc(), F.col("artist").asc()])
    return picks.select("tier", "artist", "n_tracks", "primary_genre")


@core.add(
    "p11_redrawn",
    f"""
    WITH {CATALOG}, g AS (SELECT row_no, duration, row_number() OVER (ORDER BY row_no) - 1 AS k FROM cat WHERE duration >= 2000), n AS (SELECT count(*) AS n FROM g),
    b AS (SELECT row_no AS drawn_for, CAST(floor(('0x' || md5('5|' || row_no)[1:10])::BIGINT / 1099511627776.0 * n) AS BIGINT) AS k FROM cat, n WHERE NOT coalesce(duration >= 2000, false))
    SELECT row_no, duration, CAST(NULL AS BIGINT) AS drawn_for FROM g UNION ALL SELECT row_no, duration, drawn_for FROM b JOIN g USING (k)
    """,
)
def p11_redrawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of at least 20 seconds; each shorter one is replaced by one of them, drawn by its key."""
    c = catalog(spark, sf_dir).select("row_no", "duration")
    return ct.redrawn(c, "row_no", F.col("duration") >= 2000, ["row_no"], 5)


@core.add("d06_ordered_map", f"WITH {CATALOG} SELECT row_number() OVER (ORDER BY duration, row_no) - 1 AS idx, row_no * 2 AS twice FROM cat")
def d06_ordered_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function over batches in parallel, its results in the order given."""

    def twice(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            yield pa.RecordBatch.from_arrays([pc.multiply(b.column("row_no"), 2)], ["twice"])

    return ct.ordered_map(catalog(spark, sf_dir).select("row_no", "duration"), [F.col("duration").asc_nulls_last(), F.col("row_no")], twice, "twice bigint").select("idx", "twice")


@core.add(
    "o06_walk_order",
    f"""
    WITH {_PICKS}, f AS (SELECT top.*, CASE WHEN picks.artist IS NULL THEN 1 ELSE 0 END AS fb FROM top LEFT JOIN picks ON top.artist = picks.artist),
    n AS (SELECT *, row_number() OVER (PARTITION BY tier, fb ORDER BY place) AS n FROM f)
    SELECT artist, tier, row_number() OVER (ORDER BY fb, n, CASE tier WHEN 'low' THEN 1 WHEN 'mid' THEN 2 ELSE 3 END) AS walk_no FROM n
    """,
)
def o06_walk_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picks first, then the others round-robin."""
    r = _ranked(spark, sf_dir, 5)
    w = ct.walk_order(r, ct.diverse_picks(r, "tier", "place", "primary_genre"), "artist", "tier", "place")
    return w.select("artist", "tier", F.col("walk_no").cast("bigint").alias("walk_no"))


@core.add("w10_empirical_cdf", f"WITH {ARTISTS} SELECT DISTINCT n_tracks, count(*) OVER (PARTITION BY n_tracks) AS n, round(cume_dist() OVER (ORDER BY n_tracks), 10) AS cdf FROM artists")
def w10_empirical_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of artists with at most so many tracks."""
    return rk.empirical_cdf(artists(spark, sf_dir), "n_tracks").withColumn("cdf", F.round("cdf", 10))


@core.add("w14_sequence_numbers", "SELECT event_id, row_number() OVER (ORDER BY user_id NULLS FIRST, event_id) - 1 AS idx FROM events")
def w14_sequence_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global numbers in an order, without a single task for the whole."""
    return ct.sequence_numbers(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id", "event_id"]).select("event_id", "idx")


@core.add("o01_prolific_first", f"WITH {ARTISTS} SELECT artist, n_tracks, row_number() OVER (ORDER BY n_tracks DESC, artist NULLS FIRST) - 1 AS place FROM artists")
def o01_prolific_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All artists in order, the most prolific first, ties by id."""
    a = artists(spark, sf_dir).select("artist", "n_tracks")
    return ct.sequence_numbers(a, [F.col("n_tracks").desc(), F.col("artist").asc_nulls_first()], "place")


@core.add("o02_tracks_in_order", f"WITH {CATALOG} SELECT artist, row_no, row_number() OVER (PARTITION BY artist ORDER BY album, row_no) AS place FROM cat")
def o02_tracks_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each artist's tracks in order of album and row."""
    from pyspark.sql import Window

    c = catalog(spark, sf_dir)
    return c.select("artist", "row_no", F.row_number().over(Window.partitionBy("artist").orderBy("album", "row_no")).cast("bigint").alias("place"))


@core.add("o03_pool_prefix", f"WITH {CATALOG} SELECT row_no, artist FROM cat ORDER BY row_no LIMIT 500")
def o03_pool_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of the pool."""
    return catalog(spark, sf_dir).orderBy("row_no").select("row_no", "artist").limit(500)


@core.add("o04_cap_per_artist", f"WITH {CATALOG} SELECT artist, row_no FROM cat QUALIFY row_number() OVER (PARTITION BY artist ORDER BY row_no) <= 5")
def o04_cap_per_artist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each artist's first five tracks."""
    return rk.cap_per_group(catalog(spark, sf_dir).select("artist", "row_no"), ["artist"], [F.col("row_no")], 5)


@core.add(
    "o05_numeric_suffix_order",
    "SELECT s_name, row_number() OVER (ORDER BY CAST(regexp_extract(s_name, '([0-9]+)$', 1) AS BIGINT)) - 1 AS place FROM supplier",
)
def o05_numeric_suffix_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in order of the number at their end."""
    from tonearm.functions.scalar import trailing_number

    s = table(spark, sf_dir, "supplier").select("s_name", trailing_number("s_name").alias("k"))
    return ct.sequence_numbers(s, ["k"], "place").select("s_name", "place")


@core.add("o07_restore_order", f"WITH {CATALOG} SELECT row_no, genre FROM cat")
def o07_restore_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of scattered work, back in order of submission."""
    return catalog(spark, sf_dir).select("row_no", "genre").repartition(8, "genre").orderBy("row_no")


@core.add(
    "j03_two_left_joins",
    """
    WITH c AS (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY l_suppkey)
    SELECT s_suppkey, s_name, n_name, coalesce(n, 0) AS n FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN c ON s_suppkey = l_suppkey
    """,
)
def j03_two_left_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics with the manifest and the counts joined to them."""
    c = table(spark, sf_dir, "lineitem").where("l_quantity > 25").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    out = s.join(n, s.s_nationkey == n.n_nationkey, "left").join(c, s.s_suppkey == c.l_suppkey, "left")
    return out.select("s_suppkey", "s_name", "n_name", F.coalesce("n", F.lit(0)).alias("n"))


@core.add(
    "r01_hashed_subset",
    f"""
    WITH {CATALOG} SELECT row_no, artist FROM cat ORDER BY md5('42|' || row_no), row_no
    LIMIT (SELECT greatest(1, CAST(floor(count(*) * 0.1) AS BIGINT)) FROM cat)
    """,
)
def r01_hashed_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded subset, in order."""
    return ct.fraction_subset(catalog(spark, sf_dir).select("row_no", "artist"), "row_no", 0.1, 42).orderBy("row_no")


@core.add(
    "r02_cells",
    f"""
    WITH {ARTISTS}, a AS (SELECT artist, n_tracks, artist % 10 AS v FROM artists WHERE artist IS NOT NULL),
    c1 AS (SELECT artist, n_tracks, 'low' AS band, md5('42|low|' || artist) AS h FROM a WHERE v <= 4 ORDER BY h, artist LIMIT 3),
    c2 AS (SELECT artist, n_tracks, 'mid' AS band, md5('42|mid|' || artist) AS h FROM a WHERE v BETWEEN 3 AND 7 AND artist NOT IN (SELECT artist FROM c1) ORDER BY h, artist LIMIT 4),
    c3 AS (SELECT artist, n_tracks, 'high' AS band, md5('42|high|' || artist) AS h FROM a WHERE v >= 5 AND artist NOT IN (SELECT artist FROM c1 UNION ALL SELECT artist FROM c2) ORDER BY h, artist LIMIT 2)
    SELECT artist, n_tracks, band, CAST(row_number() OVER (ORDER BY k, h, artist) AS INTEGER) AS draw_no
    FROM (SELECT *, 1 AS k FROM c1 UNION ALL SELECT *, 2 FROM c2 UNION ALL SELECT *, 3 FROM c3)
    """,
)
def r02_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artists drawn cell by cell, none twice; a cell with too few would be an error (R2)."""
    a = artists(spark, sf_dir).select("artist", "n_tracks", (F.col("artist") % 10).alias("v"))
    cells = [{"band": "low", "high": 4, "count": 3}, {"band": "mid", "low": 3, "high": 7, "count": 4}, {"band": "high", "low": 5, "count": 2}]
    return ct.draw_cells(a.where("artist is not null"), "artist", "v", cells, 42).drop("v")


@core.add(
    "r04_stratified_draw",
    f"""
    WITH {ARTISTS}, q AS (SELECT quantile_cont(n_tracks, 0.25) AS a, quantile_cont(n_tracks, 0.5) AS b, quantile_cont(n_tracks, 0.75) AS c FROM artists),
    l AS (SELECT artist, n_tracks, CASE WHEN n_tracks <= a THEN 'low' WHEN n_tracks <= b THEN 'mid' WHEN n_tracks <= c THEN 'high' ELSE 'extra_high' END AS band FROM artists, q),
    w(band, i) AS (VALUES ('low', 0), ('mid', 1), ('high', 2), ('extra_high', 3)),
    g AS (SELECT w.band, i, count(l.band) AS cap, least(5, count(l.band)) AS given FROM w LEFT JOIN l ON w.band = l.band GROUP BY w.band, i),
    free AS (SELECT band, i, k, CAST(5 AS DOUBLE) / (k + 1) AS prio FROM (SELECT band, i, unnest(range(given, cap)) AS k FROM g)),
    won AS (SELECT band, count(*) AS n FROM (SELECT * FROM free ORDER BY prio DESC, i, k LIMIT (SELECT least(20, CAST(sum(cap) AS BIGINT)) - CAST(sum(given) AS BIGINT) FROM g)) GROUP BY band),
    s AS (SELECT g.band, given + coalesce(n, 0) AS seats FROM g LEFT JOIN won ON g.band = won.band)
    SELECT artist, n_tracks, l.band FROM l JOIN s ON l.band = s.band
    QUALIFY row_number() OVER (PARTITION BY l.band ORDER BY md5('42|' || artist), artist) <= any_value(seats) OVER (PARTITION BY l.band)
    """,
)
def r04_stratified_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded draw of artists from each stratum, by reconciled quotas."""
    q = ct.quartiles(artists(spark, sf_dir), "n_tracks").select("artist", "n_tracks", "band")
    caps = {r.band: r["count"] for r in q.groupBy("band").count().collect()}
    bands = ["low", "mid", "high", "extra_high"]
    quotas = ct.reconcile_quotas({b: 5 for b in bands}, {b: caps.get(b, 0) for b in bands}, min(20, sum(caps.values())))
    return ct.stratified_draw(q, "band", "artist", quotas, 42)


@core.add(
    "r03_quota_reconcile",
    """
    WITH RECURSIVE c(band, i, quota, cap) AS (VALUES ('low', 0, 8, 3), ('mid', 1, 4, 10), ('high', 2, 5, 6), ('extra_high', 3, 3, 40)),
    g AS (SELECT band, i, quota, cap, least(quota, cap) AS given FROM c),
    free AS (SELECT band, i, k, CAST(quota AS DOUBLE) / (k + 1) AS prio FROM (SELECT band, i, quota, unnest(range(given, cap)) AS k FROM g)),
    won AS (SELECT band, count(*) AS n FROM (SELECT * FROM free ORDER BY prio DESC, i, k LIMIT (SELECT 20 - sum(given) FROM g)) GROUP BY band)
    SELECT band, CAST(given + coalesce(n, 0) AS BIGINT) AS seats FROM g LEFT JOIN won USING (band)
    """,
)
def r03_quota_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seats by band where one band can't fill its quota."""
    seats = ct.reconcile_quotas({"low": 8, "mid": 4, "high": 5, "extra_high": 3}, {"low": 3, "mid": 10, "high": 6, "extra_high": 40}, 20)
    return spark.createDataFrame(list(seats.items()), "band string, seats bigint")


@core.add(
    "r06_prompt_grid",
    """
    WITH s AS (SELECT s_name, row_number() OVER (ORDER BY s_name) AS k FROM supplier WHERE s_suppkey < 4),
    o AS (SELECT s_name, k, unnest(range(4)) AS i FROM s)
    SELECT CAST((k - 1) * 4 + i + 1 AS INTEGER) AS prompt_no, 'on_genre' AS kind, s_name AS linked_seller, ['alpha', 'beta', 'gamma'][i % 3 + 1] AS text FROM o
    UNION ALL SELECT CAST(i + 17 AS INTEGER), 'control', NULL, ['x', 'y'][i % 2 + 1] FROM (SELECT unnest(range(4)) AS i)
    """,
)
def r06_prompt_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty prompts for four sellers."""
    s = table(spark, sf_dir, "supplier").where("s_suppkey < 4")
    return ct.prompt_grid(s, "s_name", 4, 20, ["alpha", "beta", "gamma"], ["x", "y"])


@core.add(
    "r07_prompt_pool",
    f"""
    WITH {CATALOG}, p AS (SELECT row_no, genre FROM cat ORDER BY md5('7|' || row_no), row_no LIMIT 30), n AS (SELECT *, row_number() OVER (ORDER BY row_no) - 1 AS query_index FROM p)
    SELECT 'query_' || lpad(CAST(query_index AS VARCHAR), 4, '0') AS prompt_id, query_index, row_no, genre FROM n
    """,
)
def r07_prompt_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of some tracks in seeded order, numbered."""
    from tonearm.functions.scalar import padded

    some = ct.hashed_subset(catalog(spark, sf_dir), "row_no", 30, 7)
    return ct.sequence_numbers(some, ["row_no"], "query_index").select(padded("query_", "query_index", 4).alias("prompt_id"), "query_index", "row_no", "genre")
