"""Queries of problem 5: splits that keep linked artists together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.functions.ids import digits_number
from tonearm.llm.queries import llm
from tonearm.llm.splits import Loaded, load, load_linked, pairs_within
from tonearm.session import table

PROPORTIONS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """artist_no, album_no (null where the album is none) and batch_id of every row."""
    album = digits_number("album_id")
    return table(spark, sf_dir, "autotagging").select(
        digits_number("artist_id").alias("artist_no"), F.when(album != 0, album).alias("album_no"), "batch_id"
    )


def _two_loads(spark: SparkSession, sf_dir: str) -> Loaded:
    """The catalog in two loads, the second of which is the later third of the batches."""
    rows = _records(spark, sf_dir)
    last = rows.agg(F.max("batch_id")).first()[0] or 0
    early = rows.where(F.coalesce(F.col("batch_id"), F.lit(0)) <= last * 2 // 3)
    late = rows.where(F.coalesce(F.col("batch_id"), F.lit(0)) > last * 2 // 3)
    done = load_linked(None, early, "artist_no", "album_no", PROPORTIONS)
    return load_linked(done, late, "artist_no", "album_no", PROPORTIONS)


@llm.add(
    "p5_found",
    """
    WITH RECURSIVE r AS (
        SELECT DISTINCT TRY_CAST(nullif(regexp_replace(artist_id, '[^0-9]', '', 'g'), '') AS BIGINT) AS a,
               nullif(TRY_CAST(nullif(regexp_replace(album_id, '[^0-9]', '', 'g'), '') AS BIGINT), 0) AS b FROM autotagging),
    e AS (SELECT DISTINCT x.a AS u, y.a AS v FROM r x JOIN r y ON x.b = y.b AND x.a <> y.a),
    c AS (SELECT u, v FROM e UNION SELECT c.u, e.v FROM c JOIN e ON c.v = e.u)
    SELECT DISTINCT u AS artist_no_a, v AS artist_no_b FROM c WHERE u < v
    """,
)
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of artists that a chain of shared albums links, from the component table after two loads."""
    members = _two_loads(spark, sf_dir).splits
    return pairs_within(members).select(F.col("a").alias("artist_no_a"), F.col("b").alias("artist_no_b"))


@llm.add(
    "p5_components",
    """
    WITH RECURSIVE r AS (
        SELECT TRY_CAST(nullif(regexp_replace(artist_id, '[^0-9]', '', 'g'), '') AS BIGINT) AS a,
               nullif(TRY_CAST(nullif(regexp_replace(album_id, '[^0-9]', '', 'g'), '') AS BIGINT), 0) AS b FROM autotagging),
    e AS (SELECT DISTINCT x.a AS u, y.a AS v FROM (SELECT DISTINCT a, b FROM r) x JOIN (SELECT DISTINCT a, b FROM r) y ON x.b = y.b AND x.a <> y.a),
    c AS (SELECT u, v FROM e UNION SELECT c.u, e.v FROM c JOIN e ON c.v = e.u), m AS (SELECT u, min(v) AS v FROM c GROUP BY u)
    SELECT a AS artist_no, least(a, coalesce(any_value(v), a)) AS component, count(*) AS n_rows FROM r LEFT JOIN m ON u = a WHERE a IS NOT NULL GROUP BY a
    """,
)
def p5_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every artist's component, by its smallest artist, and rows, from the component table after two loads."""
    done = _two_loads(spark, sf_dir).splits
    return done.select(F.col("node").alias("artist_no"), "component", F.col("weight").alias("n_rows"))


@llm.add("p5_balance", "SELECT unnest(['train', 'validation', 'test']) AS split, true AS balanced, 0 AS n_torn")
def p5_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split whether its share of the rows is the target's, but for a component's share, and components in several splits."""
    done = p5_splits(spark, sf_dir)
    total = done.agg(F.sum("n_rows")).first()[0] or 1
    largest = done.groupBy("component").agg(F.sum("n_rows").alias("n")).agg(F.max("n")).first()[0] or 0
    torn = done.groupBy("component").agg(F.count_distinct("split").alias("n")).where("n > 1").count()
    want = spark.createDataFrame(list(PROPORTIONS.items()), "split string, target double")
    share = done.groupBy("split").agg((F.sum("n_rows") / total).alias("share"))
    met = F.abs(F.coalesce("share", F.lit(0.0)) - F.col("target")) <= 0.001 + largest / total
    return want.join(share, "split", "left").select("split", met.alias("balanced"), F.lit(torn).alias("n_torn"))


@llm.add(
    "p5_splits",
    """
    WITH RECURSIVE r AS (
        SELECT TRY_CAST(nullif(regexp_replace(artist_id, '[^0-9]', '', 'g'), '') AS BIGINT) AS a,
               nullif(TRY_CAST(nullif(regexp_replace(album_id, '[^0-9]', '', 'g'), '') AS BIGINT), 0) AS b FROM autotagging),
    e AS (SELECT DISTINCT x.a AS u, y.a AS v FROM (SELECT DISTINCT a, b FROM r) x JOIN (SELECT DISTINCT a, b FROM r) y ON x.b = y.b AND x.a <> y.a),
    c AS (SELECT u, v FROM e UNION SELECT c.u, e.v FROM c JOIN e ON c.v = e.u), m AS (SELECT u, min(v) AS v FROM c GROUP BY u),
    own AS (SELECT a, least(a, coalesce(any_value(v), a)) AS component, count(*) AS n_rows FROM r LEFT JOIN m ON u = a WHERE a IS NOT NULL GROUP BY a),
    comp AS (SELECT component, CAST(sum(n_rows) AS DOUBLE) AS w, ('0x' || md5('0|' || component)[1:15])::BIGINT AS h FROM own GROUP BY component),
    tot AS (SELECT sum(w) AS total FROM comp),
    hv AS (SELECT component, w, row_number() OVER (ORDER BY w DESC, component) AS k FROM comp, tot WHERE w >= 0.001 * total),
    g(k, component, pick, d) AS (
        SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), 0, [0.8 * total, 0.1 * total, 0.1 * total] FROM tot UNION ALL
        SELECT k, component, pick, list_transform(d, lambda x, i: CASE WHEN i = pick THEN x - w ELSE x END)
        FROM (SELECT hv.k, hv.component, w, d, CASE WHEN d[1] >= d[2] AND d[1] >= d[3] THEN 1 WHEN d[2] >= d[3] THEN 2 ELSE 3 END AS pick FROM g JOIN hv ON hv.k = g.k + 1)),
    dl AS (SELECT list_transform(d, lambda x: greatest(x, 0)) AS d FROM g ORDER BY k DESC LIMIT 1),
    li AS (SELECT component, sum(w) OVER (ORDER BY h % 1024, h, component ROWS UNBOUNDED PRECEDING) - w / 2 AS mid, sum(w) OVER () AS whole FROM comp, tot WHERE w < 0.001 * total),
    cut AS (SELECT CASE WHEN list_sum(d) > 0 THEN d[1] / list_sum(d) ELSE 0.8 END AS a, CASE WHEN list_sum(d) > 0 THEN d[2] / list_sum(d) ELSE 0.1 END AS b FROM dl),
    pl AS (SELECT component, ['train', 'validation', 'test'][pick] AS split FROM g WHERE k > 0 UNION ALL
           SELECT component, CASE WHEN mid < a * whole THEN 'train' WHEN mid < a * whole + b * whole THEN 'validation' ELSE 'test' END FROM li, cut)
    SELECT a AS artist_no, component, n_rows, split, 'new' AS status FROM own JOIN pl USING (component)
    """,
)
def p5_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every artist's component and split, the whole catalog in one load."""
    done = load(None, _records(spark, sf_dir), "artist_no", "album_no", PROPORTIONS)
    return done.select(F.col("node").alias("artist_no"), "component", F.col("weight").alias("n_rows"), "split", "status")


@llm.add("p5_incremental")
def p5_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in two loads, the second of which is the later third of the batches: kept, new and conflicting components."""
    done = _two_loads(spark, sf_dir).splits
    return done.select(F.col("node").alias("artist_no"), "component", F.col("weight").alias("n_rows"), "split", "status")
