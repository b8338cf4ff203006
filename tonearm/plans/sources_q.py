"""Queries of sources and sinks: what is written to the shared folder and read back is what was there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.functions.ids import basename
from tonearm.plans.registry import core
from tonearm.session import table
from tonearm.sources import files, registry, sinks
from tonearm.sources import text as tx
from tonearm.storage import scratch


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")


def _folders(spark: SparkSession, sf_dir: str) -> str:
    """A folder of one file a nation, each in a folder of its own."""
    root = scratch(spark, "folders")
    _nations(spark, sf_dir).coalesce(1).write.partitionBy("n_nationkey").parquet(root)
    return root


def _of_path() -> Column:
    return F.regexp_extract("path", "n_nationkey=([0-9]+)", 1).cast("bigint")


@core.add("s01_scan_files", "SELECT n_nationkey, true AS filled FROM nation")
def s01_scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files below a folder by extension, without a dot and in any case; names and sizes only."""
    return files.scan(spark, _folders(spark, sf_dir), ["PARQUET", ".txt"]).select(_of_path().alias("n_nationkey"), (F.col("size") > 0).alias("filled"))


@core.add("s02_scan_by_keyword", "SELECT 'PART-' AS keyword, count(*) AS n FROM nation UNION ALL SELECT 'nothing', 0")
def s02_scan_by_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose name has a keyword."""
    root = _folders(spark, sf_dir)
    found = [files.scan(spark, root, [".parquet"], [k]).agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("keyword"), "n") for k in ("PART-", "nothing")]
    return found[0].union(found[1])


@core.add("s03_scan_roots", "SELECT n_nationkey, 2 AS n FROM nation")
def s03_scan_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several roots one after the other; what lies below two is listed twice."""
    root = _folders(spark, sf_dir)
    return files.scan_roots(spark, [root, root], [".parquet"]).groupBy(_of_path().alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))


@core.add("s04_latents", "SELECT n_nationkey || '.npy' AS name, 'listed' AS kind FROM nation UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 'scanned' FROM nation")
def s04_latents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latents by the list in their folder, or by a scan where there is none."""
    root = scratch(spark, "latents")
    sinks.write_lines(_nations(spark, sf_dir).select(F.concat(F.col("n_nationkey").cast("string"), F.lit(".npy")).alias("f")), "f", f"{root}/filelist.txt")
    listed = files.latents(spark, root, [".npy"]).select(basename("path").alias("name"), F.lit("listed").alias("kind"))
    return listed.union(files.latents(spark, _folders(spark, sf_dir), [".parquet"]).select(_of_path().cast("string"), F.lit("scanned")))


@core.add("s05_discover", "SELECT 'n_nationkey=' || n_nationkey AS folder FROM nation")
def s05_discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files sorted by path with their root and what is below it."""
    return files.discover(spark, [_folders(spark, sf_dir)], [".parquet"]).select(F.substring_index("relpath", "/", 1).alias("folder"))


@core.add("s07_roots_of_config", "SELECT '/data/' || n_name AS root FROM nation")
def s07_roots_of_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folders that a configuration document names."""
    path = scratch(spark, "config")
    sets = F.struct(F.col("n_name").alias("id"), F.concat(F.lit("/data/"), F.col("n_name")).alias("path"))
    doc = _nations(spark, sf_dir).agg(F.collect_list(sets).alias("datasets")).select(F.lit("audio_dir").alias("dataset_type"), "datasets")
    sinks.write_document(doc, path)
    return spark.createDataFrame([(r,) for r in files.roots_of_config(spark, path)], "root string")


@core.add("s19_largest_first", "SELECT row_number() OVER (ORDER BY CAST(n_nationkey AS VARCHAR)) - 1 AS idx, n_nationkey, true AS too_large FROM nation ORDER BY CAST(n_nationkey AS VARCHAR) LIMIT 12")
def s19_largest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first files of a folder by path, with a flag for those over a size."""
    some = files.largest_first(spark, _folders(spark, sf_dir), [".parquet"], 12, 10)
    return some.select("idx", _of_path().alias("n_nationkey"), "too_large")


@core.add("s20_objects", "SELECT n_nationkey FROM nation")
def s20_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects by the URI of their folder."""
    root = _folders(spark, sf_dir)
    uri = root if "://" in root else "file://" + root.removeprefix("file:")
    return files.objects(spark, [uri.replace("=", "%3D")], [".parquet"]).select(_of_path().alias("n_nationkey"))


@core.add("s21_tar_members", "SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'even' END AS extra FROM nation")
def s21_tar_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of tar shards, written and read as streams."""
    root = scratch(spark, "shards")
    spark.createDataFrame([], "x int").write.parquet(root)  # makes the folder
    rows = _nations(spark, sf_dir).select("n_nationkey", F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, "even").alias("extra"))
    sinks.write_shards(rows, root, "n_nationkey", ["name", "extra"], 4)
    got = files.members(spark, root)
    text = lambda n: F.try_element_at("fields", F.lit(n)).cast("string").alias(n)
    return got.select("key", text("name"), text("extra"))


@core.add("s23_cached", "SELECT n_nationkey, n_name, 2 AS made FROM nation")
def s23_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache that is made anew only when what it is made of changes: asked for four times, made twice."""
    path, made = scratch(spark, "cache"), []

    def make() -> DataFrame:
        made.append(1)
        return _nations(spark, sf_dir).select("n_nationkey", "n_name")

    for model in ("a", "a", "b", "b"):
        got = registry.cached(spark, path, {"model": model, "rate": "1"}, make)
    return got.withColumn("made", F.lit(len(made)))


@core.add("s24_manifest", "SELECT 'query_' || lpad(CAST(n_nationkey AS VARCHAR), 4, '0') AS prompt_id, n_name AS prompt, n_name || '.wav' AS filename, CAST(n_nationkey AS DOUBLE) AS seconds_total FROM nation")
def s24_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of a manifest document."""
    path = scratch(spark, "manifest")
    item = F.struct(
        F.format_string("query_%04d", "n_nationkey").alias("prompt_id"),
        F.col("n_name").alias("prompt"),
        F.concat("n_name", F.lit(".wav")).alias("filename"),
        F.col("n_nationkey").cast("double").alias("seconds_total"),
    )
    sinks.write_document(_nations(spark, sf_dir).agg(F.collect_list(item).alias("items")), path)
    return tx.manifest_items(spark, path).select("prompt_id", "prompt", "filename", "seconds_total")


@core.add("k01_csv", "SELECT s_name, s_suppkey, round(s_acctbal, 2) AS s_acctbal FROM supplier")
def k01_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV with a fixed order of columns."""
    path = scratch(spark, "csv")
    sinks.write_csv(table(spark, sf_dir, "supplier"), path, ["s_name", "s_suppkey", "s_acctbal"])
    got = spark.read.option("header", True).schema("s_name string, s_suppkey bigint, s_acctbal double").csv(path)
    return got.withColumn("s_acctbal", F.round("s_acctbal", 2))


@core.add("k02_document", "SELECT count(*) AS n, max(n_name) AS last, CAST(NULL AS VARCHAR) AS none FROM nation")
def k02_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document, nulls kept."""
    path = scratch(spark, "document")
    sinks.write_document(_nations(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.max("n_name").alias("last"), F.lit(None).cast("string").alias("none")), path)
    assert '"none":null' in spark.read.text(path).first().value
    return spark.read.schema("n bigint, last string, none string").json(path)


@core.add("k03_jsonl", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def k03_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document a line."""
    path = scratch(spark, "jsonl")
    sinks.write_jsonl(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), path)
    return spark.read.schema("c_custkey bigint, c_name string, c_mktsegment string").json(path)


@core.add("k04_lines", "SELECT c_name AS value, row_number() OVER (ORDER BY c_name) - 1 AS line_no FROM customer")
def k04_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value a line, sorted over all files."""
    path = scratch(spark, "lines")
    sinks.write_lines(table(spark, sf_dir, "customer"), "c_name", path)
    return tx.numbered_lines(spark, path).select("value", "line_no")


@core.add(
    "k05_dedup_outputs",
    """
    WITH p AS (SELECT n_nationkey AS d, n_regionkey AS k FROM nation WHERE n_nationkey > 9)
    SELECT 'exclude' AS kind, '/a/' || d AS a, CAST(NULL AS VARCHAR) AS b FROM p UNION ALL SELECT 'pair', '/a/' || k, '/a/' || d FROM p
    UNION ALL SELECT 'summary', count(*) || ' ' || count(DISTINCT d), CAST(count(DISTINCT k) AS VARCHAR) FROM p UNION ALL SELECT 'failure', 'x', 'broken'
    """,
)
def k05_dedup_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exclude list, pairs, failures and summary of a dedup."""
    root = scratch(spark, "dedup")
    n = _nations(spark, sf_dir)
    paths = n.select(F.col("n_nationkey").alias("id"), F.concat(F.lit("/a/"), F.col("n_nationkey").cast("string")).alias("path"), F.col("n_name").alias("relpath"))
    found = n.where("n_nationkey > 9").select(F.col("n_nationkey").alias("drop"), F.col("n_regionkey").cast("bigint").alias("keep"), F.lit(0.9).alias("similarity"))
    sinks.write_dedup(found, paths, spark.createDataFrame([("x", "broken")], "path string, error string"), root)
    a = spark.read.text(f"{root}/exclude").select(F.lit("exclude").alias("kind"), F.col("value").alias("a"), F.lit(None).cast("string").alias("b"))
    pair = spark.read.schema("keep_path string, drop_path string").json(f"{root}/pairs").select(F.lit("pair"), "keep_path", "drop_path")
    s = spark.read.schema("n_pairs bigint, n_dropped bigint, n_kept_for bigint").json(f"{root}/summary")
    s = s.select(F.lit("summary"), F.concat_ws(" ", F.col("n_pairs").cast("string"), F.col("n_dropped").cast("string")), F.col("n_kept_for").cast("string"))
    return a.union(pair).union(s).union(spark.read.schema("path string, error string").json(f"{root}/failures").select(F.lit("failure"), "path", "error"))


@core.add("k07_matrix", "SELECT l_orderkey AS query, l_linenumber AS train, round(l_quantity, 2) AS score, CAST(l_orderkey // 1024 AS BIGINT) AS query_block FROM lineitem")
def k07_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A coordinate table in folders of blocks of queries."""
    path = scratch(spark, "matrix")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query"), F.col("l_linenumber").alias("train"), F.col("l_quantity").alias("score"))
    sinks.write_matrix(rows, path)
    return spark.read.parquet(path).select("query", "train", F.round("score", 2).alias("score"), F.col("query_block").cast("bigint").alias("query_block"))


@core.add(
    "k09_pairwise",
    """
    WITH a AS (SELECT s_name, row_number() OVER (ORDER BY s_suppkey DESC) - 1 AS i FROM supplier), b AS (SELECT n_name, row_number() OVER (ORDER BY n_name) - 1 AS i FROM nation)
    SELECT i AS index, s_name, n_name FROM a JOIN b USING (i)
    """,
)
def k09_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV of two lists side by side, aligned by position."""
    path = scratch(spark, "pairwise")
    s, n = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), _nations(spark, sf_dir).select("n_name")
    sinks.write_pairwise(s, n, ([F.col("s_suppkey").desc()], ["n_name"]), path, ["s_name", "n_name"])
    return spark.read.option("header", True).schema("index bigint, s_name string, n_name string").csv(path)


@core.add("k10_if_absent", "SELECT n_nationkey, 'first' AS phase FROM nation")
def k10_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phase that was run is left as it is when it runs again."""
    path = scratch(spark, "phase")
    for phase in ("first", "second"):
        sinks.write_if_absent(_nations(spark, sf_dir).select("n_nationkey", F.lit(phase).alias("phase")), path)
    return spark.read.parquet(path)


@core.add("k11_per_model", "SELECT CAST(n_regionkey AS INTEGER) AS model_id, n_nationkey FROM nation")
def k11_per_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder for each model, found again by its number."""
    path = scratch(spark, "models")
    sinks.write_per_model(_nations(spark, sf_dir).select(F.col("n_regionkey").alias("model_id"), "n_nationkey"), path)
    return spark.read.parquet(path).select(F.col("model_id").cast("int").alias("model_id"), "n_nationkey")


@core.add("d04_method_scores", "SELECT CAST(s_suppkey AS VARCHAR) AS seller_id, CAST(s_nationkey AS VARCHAR) AS prompt_id, round(s_acctbal, 2) AS score FROM supplier")
def d04_method_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of a registered method."""
    root = scratch(spark, "methods")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("seller_id"), F.col("s_nationkey").alias("prompt_id"), F.col("s_acctbal").alias("balance"))
    s.write.parquet(f"{root}/balances")
    registry.method("balance", "balances", "balance")
    return registry.method_scores(spark, root, "balance").withColumn("score", F.round("score", 2))


@core.add("d02_replacement", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN upper(text) ELSE text END AS text, coalesce(length(text), 0) AS extra FROM documents WHERE NOT coalesce(length(text) < 20, false)")
def d02_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user function's veto, replacement of the payload and further signals."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = registry.apply_metadata(
        d,
        lambda c: {"__reject__": F.length(c["text"]) < 20, "__replace__": F.when(c["doc_id"] % 2 == 0, F.upper(c["text"])), "__audio__": {"extra": F.length(c["text"]).cast("bigint")}},
        payload="text",
        prepare=lambda x: F.coalesce(x, F.lit(0).cast("bigint")),
    )
    return made.select("doc_id", "text", "extra")
