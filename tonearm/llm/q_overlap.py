"""Queries of problem 6: evaluation recordings and prompts in the training pool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.functions.ids import basename, first_number
from tonearm.llm.overlap import near_same
from tonearm.llm.queries import llm
from tonearm.session import table


def path_number(path: str) -> Column:
    """The number that ends the file name apart from extension and .2min, else the folder's number."""
    stem = F.regexp_replace(F.regexp_replace(basename(path), r"\.[^.]*$", ""), r"(?i)\.2min$", "")
    folder = F.when(F.contains(F.col(path), F.lit("/")), basename(F.regexp_replace(path, r"/[^/]*$", "")))
    return F.coalesce(F.regexp_extract(stem, "([0-9]+)$", 1).try_cast("bigint"), first_number(folder))


_SQL = r"""
    WITH c AS (SELECT DISTINCT caption_id, track_id AS no, prompt FROM song_describer WHERE caption_id IS NOT NULL),
    t0 AS (SELECT *, regexp_replace(regexp_replace(regexp_extract(relpath, '[^/]*$'), '\.[^.]*$', ''), '\.2min$', '', 'i') AS stem,
                  regexp_extract(regexp_replace(relpath, '/[^/]*$', ''), '[^/]*$') AS folder FROM audio_subset_records),
    t AS (SELECT DISTINCT global_index, prompt, coalesce(track_id, TRY_CAST(nullif(regexp_extract(stem, '[0-9]+$'), '') AS BIGINT),
                 CASE WHEN contains(relpath, '/') THEN TRY_CAST(nullif(regexp_extract(folder, '[0-9]+'), '') AS BIGINT) END) AS no FROM t0
          WHERE global_index IS NOT NULL),
    cw AS (SELECT caption_id, list_distinct(regexp_extract_all(lower(strip_accents(prompt)), '[\p{L}\p{N}]+')) AS w FROM (SELECT DISTINCT caption_id, prompt FROM c)),
    tw AS (SELECT global_index, list_distinct(regexp_extract_all(lower(strip_accents(prompt)), '[\p{L}\p{N}]+')) AS w FROM (SELECT DISTINCT global_index, prompt FROM t)),
    ce AS (SELECT caption_id, len(w) AS n, unnest(w) AS x FROM cw WHERE len(w) >= 8),
    te AS (SELECT global_index, len(w) AS m, unnest(w) AS x FROM tw WHERE len(w) >= 8),
    near AS (SELECT caption_id, global_index FROM ce JOIN te USING (x) GROUP BY caption_id, global_index
             HAVING 10 * count(*) >= 7 * (any_value(n) + any_value(m) - count(*)))
    SELECT caption_id, global_index FROM c JOIN t USING (no) UNION SELECT caption_id, global_index FROM near
"""


def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    captions = table(spark, sf_dir, "song_describer").where("caption_id is not null")
    pool = table(spark, sf_dir, "audio_subset_records").where("global_index is not null")
    numbered = pool.select("global_index", F.coalesce(F.col("track_id"), path_number("relpath")).alias("no"))
    same = captions.select("caption_id", F.col("track_id").alias("no")).join(numbered, "no").select("caption_id", "global_index")
    near = near_same(captions, pool, "caption_id", "prompt", "global_index", "prompt", "0.7", 8)
    return same.union(near.select("eval", "train")).distinct()


@llm.add("p6_found", _SQL)
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions and training records of the same track or with nearly the same prompt."""
    return _overlaps(spark, sf_dir)


@llm.add(
    "p6_report",
    f"""
    WITH p AS ({_SQL}), s AS (SELECT DISTINCT caption_id, eval_split FROM song_describer),
    d AS (SELECT DISTINCT global_index, dataset_id FROM audio_subset_records)
    SELECT eval_split, dataset_id, count(*) AS n_pairs, count(DISTINCT caption_id) AS n_captions, count(DISTINCT global_index) AS n_records
    FROM p JOIN s USING (caption_id) JOIN d USING (global_index) GROUP BY eval_split, dataset_id
    """,
)
def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps per evaluation split and source."""
    split = table(spark, sf_dir, "song_describer").select("caption_id", "eval_split").distinct()
    source = table(spark, sf_dir, "audio_subset_records").select("global_index", "dataset_id").distinct()
    return (
        _overlaps(spark, sf_dir)
        .join(split, "caption_id")
        .join(source, "global_index")
        .groupBy("eval_split", "dataset_id")
        .agg(F.count(F.lit(1)).alias("n_pairs"), F.count_distinct("caption_id").alias("n_captions"), F.count_distinct("global_index").alias("n_records"))
    )
