"""Queries of paths, tags and matching: F1-F14, J4-J8, J10-J12, J16, P1-P3, P7-P14, S6, S8-S13, U1-U5 and exclusion lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.functions import paths as pa
from tonearm.functions import scalar as sc
from tonearm.functions.arrays import is_silent, peak_db, silence_ratio
from tonearm.functions.ids import basename
from tonearm.operators import matching as mt
from tonearm.plans.registry import core
from tonearm.session import table
from tonearm.sources import text as tx
from tonearm.sources.files import parsed_extensions

_NAME = "regexp_extract({}, '[^/]*$')"
_STEM = "regexp_replace(regexp_extract({0}, '[^/]*$'), '(.)\\.[^.]*$', '\\1')"


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "audio_subset_records")


@core.add(
    "f01_trailing_number",
    "SELECT s_suppkey, TRY_CAST(nullif(regexp_extract(s_name, '([0-9]+)$', 1), '') AS BIGINT) AS num, TRY_CAST(nullif(regexp_extract(s_name || 'x', '([0-9]+)$', 1), '') AS BIGINT) AS none FROM supplier",
)
def f01_trailing_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digits at the end of an id."""
    return table(spark, sf_dir, "supplier").select("s_suppkey", sc.trailing_number("s_name").alias("num"), sc.trailing_number(F.concat("s_name", F.lit("x"))).alias("none"))


@core.add(
    "f02_first_number_of_name",
    f"""
    SELECT global_index, TRY_CAST(nullif(regexp_extract({_NAME.format("path")}, '[0-9]+'), '') AS BIGINT) AS first_no,
           TRY_CAST(nullif(regexp_extract({_NAME.format("path")}, '([0-9]+)\\.[^.]+$', 1), '') AS BIGINT) AS last_no FROM audio_subset_records
    """,
)
def f02_first_number_of_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First number of a file name, and the one before the extension."""
    return _pool(spark, sf_dir).select("global_index", sc.first_number_of_name("path").alias("first_no"), sc.last_number_before_extension(basename("path")).alias("last_no"))


_TAG = "'mood/theme---' || event_type || '__' || CAST(event_id % 7 AS VARCHAR) || '  x '"


@core.add(
    "f04_clean_tags",
    f"""
    SELECT event_id, nullif(trim(regexp_replace(replace({_TAG}, '_', ' '), '\\s+', ' ', 'g')), '') AS whole, 'mood/theme' AS kind,
           trim(regexp_replace(replace(event_type || '__' || CAST(event_id % 7 AS VARCHAR) || '  x ', '_', ' '), '\\s+', ' ', 'g')) AS value FROM events
    """,
)
def f04_clean_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags cleaned, and split into type and value."""
    t = F.concat(F.lit("mood/theme---"), F.col("event_type"), F.lit("__"), (F.col("event_id") % 7).cast("string"), F.lit("  x "))
    return table(spark, sf_dir, "events").select("event_id", sc.clean_tag(t).alias("whole"), sc.tag_type(t).alias("kind"), sc.tag_value(t).alias("value"))


@core.add(
    "f05_tags_by_type",
    """
    SELECT event_id, '{"genre":["' || event_type || '"]' || CASE WHEN event_id % 3 = 0 THEN ',"mood/theme":["Deep Sea","Calm"],"tag":["loose"]' ELSE '' END || '}' AS tags_by_type
    FROM events WHERE event_type IS NOT NULL
    """,
)
def f05_tags_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map from type, in lower case, to the cleaned values of an array of tags."""
    k = F.col("event_id")
    more = F.when(k % 3 == 0, F.array(*(F.lit(x) for x in ("Mood/Theme---Deep_Sea", "loose", " mood/theme---  Calm ", "genre---_")))).otherwise(F.array().cast("array<string>"))
    tags = F.concat(F.array(F.concat(F.lit("GENRE---"), F.col("event_type"))), more)
    e = table(spark, sf_dir, "events").where("event_type is not null")
    return e.select("event_id", F.to_json(sc.tags_by_type(tags, lower=True)).alias("tags_by_type"))


@core.add("f05_tag_map")
def f05_tag_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map from type to values of each delivered row's packed tags."""
    from tonearm.operators.packed import split_packed

    rows = table(spark, sf_dir, "autotagging").select("line_no", "tags")
    tags = split_packed(rows, "tags").groupBy("line_no").agg(F.array_sort(F.collect_list(F.struct("position", "value"))).alias("t"))
    return tags.select("line_no", F.to_json(sc.tags_by_type(F.transform("t", lambda s: s["value"]), lower=True)).alias("tags_by_type"))


@core.add(
    "f06_candidate_keys",
    f"""
    WITH k AS (SELECT global_index, list_filter([path, path, {_NAME.format("path")}, {_STEM.format("path")}, relpath, '/' || relpath, {_NAME.format("relpath")}, {_STEM.format("relpath")}], lambda x: x IS NOT NULL) AS ks
               FROM (SELECT DISTINCT global_index, path, relpath FROM audio_subset_records WHERE path IS NOT NULL AND relpath IS NOT NULL)),
    u AS (SELECT global_index, unnest(ks) AS key FROM k)
    SELECT DISTINCT global_index, key FROM u
    """,
)
def f06_candidate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys under which a record may be found."""
    rows = _pool(spark, sf_dir).where("path is not null and relpath is not null").select("global_index", "path", "relpath").distinct()
    return rows.select("global_index", F.explode(pa.candidate_keys("path", "relpath")).alias("key")).distinct()


@core.add(
    "f07_path_parts",
    f"""
    SELECT global_index, {_NAME.format("relpath")} AS name, {_STEM.format("relpath")} AS stem, lower(regexp_extract({_NAME.format("relpath")}, '.(\\.[^.]*)$', 1)) AS suffix,
           regexp_replace(relpath, '\\.[^./]*$', '') AS bare, relpath AS normal, relpath AS below FROM audio_subset_records
    """,
)
def f07_path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, stems, suffixes; '.' and '..' folded; paths below a root."""
    messy = F.concat(F.lit("./x/../"), F.replace("relpath", F.lit("/"), F.lit("//")))
    return _pool(spark, sf_dir).select(
        "global_index",
        basename("relpath").alias("name"),
        pa.stem("relpath").alias("stem"),
        pa.suffix("relpath").alias("suffix"),
        pa.strip_extension("relpath").alias("bare"),
        pa.normpath(messy).alias("normal"),
        pa.relpath("path", "dataset_root").alias("below"),
    )


@core.add("f08_safe_members", "SELECT global_index, false AS whole_safe, true AS rel_safe, false AS up_safe FROM audio_subset_records WHERE path IS NOT NULL AND relpath IS NOT NULL")
def f08_safe_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which names stay below a root."""
    rows = _pool(spark, sf_dir).where("path is not null and relpath is not null")
    return rows.select(
        "global_index",
        pa.is_safe_member("path").alias("whole_safe"),
        pa.is_safe_member("relpath").alias("rel_safe"),
        pa.is_safe_member(F.concat(F.lit("a/../"), F.col("relpath"))).alias("up_safe"),
    )


@core.add(
    "f09_labelled_prompt",
    """
    SELECT c_custkey, 'title: ' || c_name || ', year: 1998' || CASE WHEN c_mktsegment <> 'BUILDING' THEN ', genre: ' || lower(c_mktsegment) ELSE '' END
           || ', mood: a, b, c' || CASE WHEN c_custkey % 2 = 0 THEN ', instrument: x' ELSE '' END AS prompt FROM customer
    """,
)
def f09_labelled_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled prompts of what a track has."""
    c = table(spark, sf_dir, "customer")
    genre = F.when(F.col("c_mktsegment") == "BUILDING", "unknown").otherwise(F.lower("c_mktsegment"))
    moods = F.array(*(F.lit(x) for x in "abcd"))
    instruments = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return c.select("c_custkey", sc.labelled_prompt("c_name", F.lit(""), F.lit(None).cast("string"), sc.year(F.lit("1998-05-01")), genre, moods, instruments, F.lit("?")).alias("prompt"))


_PROMPTS = """
    v AS (SELECT c_custkey, i, label, many, txt, mood FROM (
        SELECT c_custkey, 0 AS i, 'title' AS label, false AS many, c_name AS txt, [] AS mood FROM customer UNION ALL
        SELECT c_custkey, 1, 'year', false, '1998', [] FROM customer UNION ALL
        SELECT c_custkey, 2, 'mood', true, NULL, ['calm', 'dark', 'epic', 'slow', 'warm'] FROM customer UNION ALL
        SELECT c_custkey, 3, 'instrument', true, NULL, [c_mktsegment] FROM customer)),
    d AS (SELECT *, [('0x' || md5(s || '|' || c_custkey || '|' || i)[1:10])::BIGINT / 1099511627776.0 FOR s IN ['4', '5', '7']] AS u,
                 ('0x' || md5('6|' || c_custkey)[1:10])::BIGINT / 1099511627776.0 AS labelled, md5('8|' || c_custkey || '|' || i) AS spot,
                 list_transform(list_sort(list_transform(mood, lambda m: {'h': md5('3|' || c_custkey || '|' || m), 'm': m})), lambda s: s.m) AS mixed FROM v),
    f AS (SELECT *, mixed[1:CAST(least(1 + floor(u[1] * least(len(mixed), 4)), len(mixed)) AS BIGINT)] AS few FROM d),
    t AS (SELECT *, CASE WHEN many THEN array_to_string(few, ', ') ELSE txt END AS plain, CASE WHEN many AND len(few) > 1 THEN label || 's' ELSE label END AS name FROM f),
    c AS (SELECT *, CASE WHEN u[2] < 0.2 THEN lower(plain) WHEN u[2] < 0.25 THEN upper(plain) ELSE plain END AS cased FROM t),
    p AS (SELECT c_custkey, i, spot, u[3] < 0.7 AS kept, CASE WHEN labelled < 0.5 THEN name || ': ' || cased ELSE cased END AS shown FROM c),
    k AS (SELECT *, bool_or(kept) OVER (PARTITION BY c_custkey) AS any_kept FROM p)
"""


@core.add("f10_random_prompt", f"WITH {_PROMPTS} SELECT c_custkey, string_agg(shown, ', ' ORDER BY spot) AS prompt FROM k WHERE kept OR (NOT any_kept AND i = 0) GROUP BY c_custkey")
def f10_random_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded prompts of some of a track's fields."""
    c = table(spark, sf_dir, "customer")
    lists = {"mood": F.array(*(F.lit(x) for x in ("calm", "dark", "epic", "slow", "warm"))), "instrument": F.array(F.col("c_mktsegment"))}
    return c.select("c_custkey", sc.random_prompt(F.col("c_custkey"), {"title": F.col("c_name"), "year": F.lit("1998")}, lists, 3).alias("prompt"))


@core.add(
    "f12_padded_ids",
    """
    SELECT s_suppkey, 'seller_' || lpad(CAST(s_suppkey AS VARCHAR), CAST(greatest(3, len(CAST(s_suppkey AS VARCHAR))) AS INTEGER), '0') AS seller_id,
           lpad(CAST(s_suppkey % 100 AS VARCHAR), 2, '0') || '/' || CAST(s_suppkey AS VARCHAR) || '.mp3' AS shard FROM supplier
    """,
)
def f12_padded_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids with leading zeros and shard paths."""
    return table(spark, sf_dir, "supplier").select("s_suppkey", sc.padded("seller_", "s_suppkey", 3).alias("seller_id"), sc.shard_path("s_suppkey").alias("shard"))


@core.add("f13_json", """SELECT n_nationkey, '{"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || ',"none":null}' AS doc FROM nation""")
def f13_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested values as JSON."""
    from tonearm.sources.sinks import json_text

    return table(spark, sf_dir, "nation").select("n_nationkey", json_text("n_name", "n_regionkey", F.lit(None).cast("string").alias("none")).alias("doc"))


@core.add(
    "f14_token_counts",
    r"SELECT doc_id, CAST(CASE WHEN trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')), ' ')) END AS BIGINT) AS n FROM documents WHERE text IS NOT NULL",
)
def f14_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words between blanks of each document."""
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", sc.token_count("text").cast("bigint").alias("n"))


_LIST = """
    e AS (SELECT path AS entry FROM audio_subset_records WHERE global_index % 9 = 0 UNION SELECT relpath FROM audio_subset_records WHERE global_index % 9 = 1
          UNION SELECT {name} FROM audio_subset_records WHERE global_index % 9 = 2 UNION SELECT {stem} FROM audio_subset_records WHERE global_index % 9 = 3),
    hit AS (SELECT path FROM (SELECT path, unnest([path, {name}, {stem}, relpath, regexp_replace(relpath, '\\.[^./]*$', '')]) AS k FROM audio_subset_records) JOIN e ON k = entry)
""".format(name=_NAME.format("path"), stem=_STEM.format("path"))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pool(spark, sf_dir)
    k = F.col("global_index") % 9
    out = None
    for i, c in enumerate((F.col("path"), F.col("relpath"), basename("path"), pa.stem("path"))):
        one = p.where(k == i).select(c.alias("line"))
        out = one if out is None else out.union(one)
    noise = spark.createDataFrame([("# a comment",), ("  ",), ("",)], "line string")
    return mt.clean_entries(out.union(noise), "line")


def _roots(spark: SparkSession, sf_dir: str) -> list[str]:
    """The folders that a data set's records lie under; they are a setting of the data set and few."""
    found = _pool(spark, sf_dir).select("dataset_root").where("dataset_root <> ''").distinct().limit(10_001).collect()
    if len(found) > 10_000:
        raise ValueError("more than 10,000 roots")
    return sorted(r.dataset_root for r in found)


@core.add("p01_listed_paths", f"WITH {_LIST} SELECT DISTINCT path FROM hit")
def p01_listed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a list names by path, relative path, name or stem."""
    return mt.listed_paths(_pool(spark, sf_dir), "path", _entries(spark, sf_dir), _roots(spark, sf_dir)).withColumnRenamed("__path", "path")


@core.add("p02_exclude", f"WITH {_LIST} SELECT global_index, path FROM audio_subset_records WHERE path IS NULL OR path NOT IN (SELECT path FROM hit)")
def p02_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files without the listed ones."""
    return mt.exclude(_pool(spark, sf_dir), "path", _entries(spark, sf_dir), _roots(spark, sf_dir)).select("global_index", "path")


@core.add("p03_include", f"WITH {_LIST} SELECT global_index, path FROM audio_subset_records WHERE path IN (SELECT path FROM hit)")
def p03_include(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the listed files."""
    return mt.include(_pool(spark, sf_dir), "path", _entries(spark, sf_dir), _roots(spark, sf_dir)).select("global_index", "path")


@core.add("p03_include_empty", "SELECT global_index FROM audio_subset_records")
def p03_include_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty list includes everything."""
    none = spark.createDataFrame([], "entry string")
    return mt.include(_pool(spark, sf_dir), "path", none).select("global_index")


@core.add(
    "p07_leave_one_out",
    """
    WITH s AS (SELECT s_suppkey AS model_id FROM supplier WHERE s_suppkey BETWEEN 1 AND 5 UNION ALL SELECT 0)
    SELECT model_id, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem JOIN s ON l_suppkey IS DISTINCT FROM model_id OR model_id = 0 GROUP BY model_id
    """,
)
def p07_leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each model that is trained without one seller."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber")
    some = table(spark, sf_dir, "supplier").where("s_suppkey between 1 and 5").select("s_suppkey")
    return mt.leave_one_out(li, "l_suppkey", some, "s_suppkey").groupBy("model_id").agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("lines"))


@core.add("p08_without_indices", "SELECT event_id, user_id FROM events WHERE event_id IS NULL OR event_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 48)")
def p08_without_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without explicitly dropped ones, repeats kept."""
    dropped = table(spark, sf_dir, "lineitem").where("l_quantity > 48")
    return mt.without_indices(table(spark, sf_dir, "events").select("event_id", "user_id"), "event_id", dropped, "l_orderkey")


@core.add("p09_size_split", "SELECT doc_id, n_chars, 'larger than 2000' AS reason FROM documents WHERE n_chars > 2000")
def p09_size_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items skipped for their size, with the reason."""
    return mt.size_split(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", 2000)[1]


@core.add(
    "p10_row_gate",
    "SELECT doc_id, CASE WHEN text IS NULL THEN 1 WHEN lang IS NULL THEN 2 WHEN length(text) < 50 THEN 3 WHEN length(text) > 5000 THEN 4 ELSE 0 END AS code FROM documents",
)
def p10_row_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which gate stops a row: missing parts, too short, too long."""
    n = F.length("text")
    return table(spark, sf_dir, "documents").select("doc_id", mt.gate_code(F.col("text").isNull(), F.col("lang").isNull(), n < 50, n > 5000).alias("code"))


@core.add(
    "p13_silence",
    """
    WITH v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / 100) AS e FROM embeddings)
    SELECT vec_id, round(20 * log10(list_max(list_transform(e, lambda x: abs(x)))), 6) AS peak, 20 * log10(list_max(list_transform(e, lambda x: abs(x)))) < -45 AS silent,
           len(list_filter(e, lambda x: abs(x) < 0.0005)) / CAST(len(e) AS DOUBLE) AS ratio FROM v
    """,
)
def p13_silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peak level, silence and its share."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: x / 100).alias("e"))
    return v.select("vec_id", F.round(peak_db("e"), 6).alias("peak"), is_silent("e", -45.0).alias("silent"), silence_ratio("e", 0.0005).alias("ratio"))


_J4 = f"""
    b0 AS (SELECT s_suppkey AS seller, row_number() OVER (ORDER BY s_suppkey) AS o, ['/data/' || s_name || '.mp3', s_name, lower(s_name)] AS ks FROM supplier),
    b AS (SELECT key, arg_min(seller, o) AS seller FROM (SELECT seller, o, unnest(ks) AS key FROM b0) GROUP BY key),
    l AS (SELECT c_custkey AS id, unnest([1, 2, 3]) AS k, unnest(['/data/x' || c_custkey, 'Supplier#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0'), 'supplier#' || lpad(CAST(c_custkey // 2 AS VARCHAR), 9, '0')]) AS key FROM customer)
"""


@core.add("j04_priority_match", f"WITH {_J4} SELECT id, CAST(min(k) - 1 AS INTEGER) AS key_no, arg_min(seller, k) AS seller FROM l JOIN b USING (key) GROUP BY id")
def j04_priority_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of several keys that hits, and of the rows it hits the first."""
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    right = F.array(F.concat(F.lit("/data/"), "s_name", F.lit(".mp3")), F.col("s_name"), F.lower("s_name"))
    k = F.col("id")
    left = F.array(F.concat(F.lit("/data/x"), k.cast("string")), sc.padded("Supplier#", k, 9), sc.padded("supplier#", F.floor(k / 2), 9))
    return mt.priority_match(c.withColumnRenamed("c_custkey", "id"), "id", left, s.withColumnRenamed("s_suppkey", "seller"), right, [F.col("seller")], ["seller"])


@core.add(
    "j07_manifest_lookup",
    "SELECT o_orderkey, coalesce(c_name, 'none') AS name, coalesce(c_mktsegment, 'unknown') AS segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 2 = 0",
)
def j07_manifest_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup with defaults where the manifest has nothing."""
    c = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select("c_custkey", "c_name", "c_mktsegment")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return o.join(c, o.o_custkey == c.c_custkey, "left").select("o_orderkey", F.coalesce("c_name", F.lit("none")).alias("name"), F.coalesce("c_mktsegment", F.lit("unknown")).alias("segment"))


@core.add(
    "j08_prompt_ids",
    """
    WITH f AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN CAST(s_suppkey AS VARCHAR) END AS given,
               CASE WHEN s_suppkey % 2 = 0 THEN 'query_' || lpad(CAST(s_suppkey AS VARCHAR), 4, '0') || '.wav' ELSE s_name END AS file FROM supplier)
    SELECT s_suppkey, coalesce(given, CAST(TRY_CAST(nullif(regexp_extract(file, 'query_([0-9]+)', 1), '') AS BIGINT) AS VARCHAR), file) AS prompt_id FROM f
    """,
)
def j08_prompt_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt's id from the manifest, the file's number or the file's name."""
    k = F.col("s_suppkey")
    given = F.when(k % 3 == 0, k.cast("string"))
    file = F.when(k % 2 == 0, F.concat(sc.padded("query_", k, 4), F.lit(".wav"))).otherwise(F.col("s_name"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", tx.prompt_of_query(given, file).alias("prompt_id"))


@core.add(
    "j11_positional_zip",
    """
    WITH a AS (SELECT s_name, row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM supplier), b AS (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation)
    SELECT i, s_name, n_name FROM a JOIN b USING (i)
    """,
)
def j11_positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists joined by position, as far as the shorter goes."""
    from tonearm.operators.catalog import sequence_numbers

    a = sequence_numbers(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), ["s_suppkey"], "i")
    b = sequence_numbers(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), ["n_nationkey"], "i")
    return a.join(b, "i").select("i", "s_name", "n_name")


@core.add(
    "j16_metadata_override",
    "SELECT p_partkey, coalesce(CASE WHEN p_size > 25 THEN upper(p_name) END, p_name) AS p_name, p_size FROM part",
)
def j16_metadata_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with the values of a table of changes."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    return mt.override(p, p.where("p_size > 25").select("p_partkey", F.upper("p_name").alias("p_name")), ["p_partkey"])


@core.add("u01_union_all", "SELECT c_nationkey AS nation, 'c' AS kind FROM customer UNION ALL SELECT s_nationkey, 's' FROM supplier")
def u01_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks one after the other."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.lit("c").alias("kind"))
    return c.unionByName(table(spark, sf_dir, "supplier").select(F.lit("s").alias("kind"), F.col("s_nationkey").alias("nation")))


@core.add("u03_semi", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def u03_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that an include list has."""
    c = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(c, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@core.add("u05_distinct", "SELECT DISTINCT l_suppkey, l_linenumber FROM lineitem")
def u05_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair once."""
    return table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber").distinct()


_RAGGED = """
    r AS (SELECT event_id, 'track_' || lpad(CAST(event_id AS VARCHAR), 7, '0') AS track_id, 'artist_' || user_id AS artist_id, 'album_' || (event_id % 50) AS album_id,
                 (event_id % 100) || '/' || event_id || '.mp3' AS path, round(value, 2) AS duration, event_type FROM events)
"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    fields = [
        sc.padded("track_", "event_id", 7),
        F.concat(F.lit("artist_"), F.col("user_id").cast("string")),
        F.concat(F.lit("album_"), (k % 50).cast("string")),
        F.concat((k % 100).cast("string"), F.lit("/"), k.cast("string"), F.lit(".mp3")),
        F.round("value", 2).cast("string"),
        F.concat(F.lit("genre---"), F.col("event_type")),
        F.when(k % 3 == 0, F.lit("mood/theme---Deep_Sea\tinstrument---piano\tloose")),
    ]
    rows = table(spark, sf_dir, "events").select(F.concat_ws("\t", *fields).alias("value"))
    extra = spark.createDataFrame([("TRACK_ID\tARTIST_ID\tALBUM_ID\tPATH\tDURATION\tTAGS",), ("too\tshort",)], "value string")
    return rows.union(extra)


@core.add(
    "s08_ragged_rows",
    f"""
    WITH {_RAGGED} SELECT track_id, artist_id, album_id, path, duration, event_id AS track_num, [event_type] AS genres,
           CASE WHEN event_id % 3 = 0 THEN ['Deep Sea'] ELSE [] END AS moods, CAST(CASE WHEN event_id % 3 = 0 THEN 4 ELSE 1 END AS INTEGER) AS n_tags FROM r
    """,
)
def s08_ragged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ragged catalog parsed into typed rows with tags by type."""
    rows = tx.with_tag_lists(tx.ragged_catalog(_lines(spark, sf_dir)))
    return rows.select("track_id", "artist_id", "album_id", "path", "duration", "track_num", "genres", "moods", F.size("tags").alias("n_tags"))


@core.add(
    "s09_catalog_with_metadata",
    f"""
    WITH {_RAGGED} SELECT track_id, CASE WHEN event_id % 2 = 0 THEN 'new ' || event_id ELSE '' END AS track_name, CASE WHEN event_id % 2 = 0 THEN '2004' ELSE '' END AS year FROM r WHERE event_id % 4 <> 3
    """,
)
def s09_catalog_with_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Present files of a catalog with the last metadata line of each."""
    cat = tx.ragged_catalog(_lines(spark, sf_dir))
    e = table(spark, sf_dir, "events").where("event_id % 2 = 0").select("event_id", sc.padded("track_", "event_id", 7).alias("t"))
    old = e.select(F.col("event_id").alias("line_no"), F.concat_ws("\t", "t", F.lit("old"), F.lit("1999-01-01")).alias("value"))
    new = e.select((F.col("event_id") + 10**9).alias("line_no"), F.concat_ws("\t", "t", F.concat(F.lit("new "), F.col("event_id").cast("string")), F.lit("2004-02-01")).alias("value"))
    meta = tx.metadata(old.union(new), ["TRACK_ID", "TRACK_NAME", "RELEASEDATE"])
    present = cat.where(~sc.trailing_number("track_id").cast("string").rlike("x")).where(sc.trailing_number("track_id") % 4 != 3).select("path")
    return tx.join_metadata(cat, meta, present).select("track_id", "track_name", "year")


@core.add(
    "s12_artist_tracks",
    "SELECT user_id AS artist, CAST(count(*) AS INTEGER) AS n, arg_min((event_id % 100) || '/' || event_id, event_id) AS first_key FROM events GROUP BY user_id",
)
def s12_artist_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each artist's tracks as a list, keys without extension."""
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("artist"),
        "event_id",
        k.cast("string").alias("track_id"),
        F.lit("a").alias("album_id"),
        F.concat((k % 100).cast("string"), F.lit("/"), k.cast("string"), F.lit(".mp3")).alias("path"),
        F.col("value").alias("duration"),
    )
    lists = tx.tracks_of_artists(rows, "artist", "event_id")
    return lists.select("artist", F.size("tracks").alias("n"), F.get("tracks", 0)["key"].alias("first_key"))


@core.add(
    "s13_token_lines",
    "SELECT l_orderkey * 8 + l_linenumber AS k, CAST(l_suppkey AS VARCHAR) AS id, CAST(2 AS INTEGER) AS n, CAST(l_partkey AS INTEGER) AS first_token FROM lineitem",
)
def s13_token_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of tokens whose last one is an id."""
    li = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"), F.concat_ws(" ", F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_suppkey").cast("string")).alias("value"))
    t = tx.token_lines(li)
    return t.select("k", "id", F.size("tokens").alias("n"), F.get("tokens", 0).alias("first_token"))


@core.add("s06_extensions", "SELECT n_nationkey, ['.wav', '.mp3', '.flac'] AS ext FROM nation")
def s06_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comma lists of extensions."""
    return table(spark, sf_dir, "nation").select("n_nationkey", parsed_extensions(F.lit(" WAV,.mp3, ,flac,.wav")).alias("ext"))


@core.add("s16_integers", "SELECT CAST(unnest([l_orderkey, l_partkey, l_suppkey]) AS BIGINT) AS value FROM lineitem")
def s16_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integers between commas, blanks ignored."""
    li = table(spark, sf_dir, "lineitem").select(F.concat(F.col("l_orderkey").cast("string"), F.lit(", ,"), F.col("l_partkey").cast("string"), F.lit(" ,"), F.col("l_suppkey").cast("string"), F.lit(",")).alias("value"))
    return tx.integers(li)


@core.add(
    "s18_fallback_paths",
    """
    WITH s AS (SELECT DISTINCT caption_id, track_id, audio_path FROM song_describer),
    p AS (SELECT lpad(CAST(track_id % 100 AS VARCHAR), 2, '0') || '/' || track_id || CASE WHEN track_id % 3 = 0 THEN '.2min.mp3' ELSE '.mp3' END AS path FROM s WHERE track_id % 2 = 0 UNION SELECT audio_path FROM s WHERE track_id % 5 = 0)
    SELECT caption_id, track_id, audio_path, coalesce(a.path, b.path, c.path) AS found FROM s LEFT JOIN p a ON audio_path = a.path
    LEFT JOIN p b ON lpad(CAST(track_id % 100 AS VARCHAR), 2, '0') || '/' || track_id || '.2min.mp3' = b.path
    LEFT JOIN p c ON lpad(CAST(track_id % 100 AS VARCHAR), 2, '0') || '/' || track_id || '.mp3' = c.path
    """,
)
def s18_fallback_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions with the first of three places where their file is."""
    s = table(spark, sf_dir, "song_describer").select("caption_id", "track_id", "audio_path").distinct()
    short = F.when(F.col("track_id") % 3 == 0, sc.shard_path("track_id", ".2min.mp3")).otherwise(sc.shard_path("track_id"))
    there = s.where("track_id % 2 = 0").select(short.alias("path")).union(s.where("track_id % 5 = 0").select("audio_path"))
    return tx.with_fallback_path(s, "audio_path", "track_id", there)


@core.add(
    "s15_feature_blocks",
    """
    WITH a AS (SELECT s_suppkey AS row, s_name AS name FROM supplier WHERE s_suppkey < 7), b AS (SELECT n_nationkey + 7 AS row, n_name AS name FROM nation WHERE n_nationkey < 20)
    SELECT CAST(row AS BIGINT) AS row, name FROM a UNION ALL SELECT row, name FROM b
    """,
)
def s15_feature_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One axis of two blocks with unused rows at their ends."""
    from tonearm.sources.registry import feature_blocks

    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row"), F.col("s_name").alias("name"))
    b = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("row"), F.col("n_name").alias("name"))
    return feature_blocks([(a, 7), (b, 20)])


@core.add("s25_numbered_folders", "SELECT s_suppkey::INTEGER AS model_id, '/m/' || s_suppkey AS path FROM supplier")
def s25_numbered_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders whose name is a number, in order of the number."""
    from tonearm.sources.files import numbered_folders

    s = table(spark, sf_dir, "supplier")
    both = s.select(F.concat(F.lit("/m/"), F.col("s_suppkey").cast("string")).alias("path")).union(s.select(F.concat(F.lit("/m/"), F.col("s_name")).alias("path")))
    return numbered_folders(both, "path")


@core.add("d01_metadata_function", "SELECT doc_id, upper(lang) AS lang, length(text) > 500 AS long FROM documents WHERE NOT coalesce(length(text) < 100, false)")
def d01_metadata_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns made by a user function, and its veto."""
    from tonearm.sources.registry import apply_metadata

    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    made = apply_metadata(d, lambda c: {"lang": F.upper(c["lang"]), "long": F.length(c["text"]) > 500, "__reject__": F.length(c["text"]) < 100})
    return made.select("doc_id", "lang", "long")


@core.add("d05_converters", "SELECT doc_id, coalesce(lower(coalesce(author, source)), '-') AS who FROM documents")
def d05_converters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Converters with default columns."""
    from tonearm.sources.registry import converted

    d = table(spark, sf_dir, "documents").select("doc_id", F.col("author").alias("who"), "source")
    return converted(d, {"who": lambda c: F.coalesce(F.lower(c), F.lit("-"))}, {"who": "source"}).select("doc_id", "who")


@core.add("k06_subset_manifest", "SELECT row_number() OVER (ORDER BY global_index, path) - 1 AS pool_index, global_index, dataset_id, dataset_root, track_id, path, relpath FROM audio_subset_records")
def k06_subset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest with positions."""
    from tonearm.sources.sinks import subset_manifest

    return subset_manifest(_pool(spark, sf_dir), ["global_index", "path"])


@core.add("k12_sample_ids", "SELECT l_orderkey, l_linenumber, '003' || lpad(CAST(l_orderkey AS VARCHAR), 6, '0') || lpad(CAST(l_linenumber AS VARCHAR), 4, '0') AS id FROM lineitem")
def k12_sample_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of rank, batch and item."""
    from tonearm.sources.sinks import sample_id

    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", sample_id(F.lit(3), F.col("l_orderkey"), F.col("l_linenumber")).alias("id"))




@core.add("s22_load_by_type", "SELECT n_nationkey, n_name FROM nation")
def s22_load_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source chosen by its type."""
    from tonearm.sources.registry import load

    return load(spark, {"dataset_type": "parquet", "datasets": [{"path": f"{sf_dir}/nation.parquet"}]}).select("n_nationkey", "n_name")


@core.add(
    "p_exclude_then_include",
    "SELECT doc_id FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 2 = 0",
)
def p_exclude_then_include(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later scan: listed paths are excluded first, then the included ones kept."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("/d/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"))
    gone = d.where("doc_id % 7 = 0").select(F.col("path").alias("entry"))
    kept = d.where("doc_id % 2 = 0").select(F.col("doc_id").cast("string").alias("entry"))
    return mt.include(mt.exclude(d, "path", gone), "path", kept).select("doc_id")

