"""Text formats: ragged tab-separated catalogs, token lines, integer lists, manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.functions.scalar import trailing_number, values_of_type, year
from tonearm.schemas import PROMPT_MANIFEST


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of a text file's lines from 0, in the file's order."""
    from tonearm.operators.catalog import sequence_numbers

    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
    return sequence_numbers(lines, ["f", "b", "m"], "line_no").select("line_no", "value")


def ragged_catalog(lines: DataFrame, line: str = "value", sep: str = "\t") -> DataFrame:
    """lines with track_id, artist_id, album_id, path, duration and tags, the array of all further fields.

    Lines of fewer than five fields, and the header, are left out; a duration that is no number is null.
    """
    f = F.split(F.regexp_replace(F.col(line), "[\r\n]+$", ""), sep)
    rows = lines.withColumn("__f", f).where((F.size("__f") >= 5) & (F.get("__f", 0) != "TRACK_ID"))
    names = ["track_id", "artist_id", "album_id", "path"]
    return rows.select(
        *lines.columns,
        *(F.get("__f", i).alias(n) for i, n in enumerate(names)),
        F.get("__f", 4).try_cast("double").alias("duration"),
        F.slice("__f", F.lit(6), F.greatest(F.size("__f") - 5, F.lit(0))).alias("tags"),
    ).drop("__f")


def with_tag_lists(catalog: DataFrame, tags: str = "tags") -> DataFrame:
    """catalog with genres, moods and instruments, the cleaned values of its tags by type, and track_num."""
    return catalog.withColumns(
        {
            "genres": values_of_type(tags, "genre"),
            "moods": values_of_type(tags, "mood/theme"),
            "instruments": values_of_type(tags, "instrument"),
            "track_num": trailing_number("track_id"),
        }
    )


def metadata(lines: DataFrame, header: Sequence[str], line_no: str = "line_no", line: str = "value", sep: str = "\t") -> DataFrame:
    """One row per TRACK_ID with the header's columns in lower case and year: the last line of an id wins, short lines don't count."""
    from tonearm.operators.ranking import last_per_group

    f = F.split(F.regexp_replace(F.col(line), "[\r\n]+$", ""), sep)
    rows = lines.withColumn("__f", f).where((F.size("__f") >= len(header)) & (F.get("__f", 0) != header[0]))
    cols = [F.get("__f", i).alias(h.lower()) for i, h in enumerate(header)]
    rows = rows.select(line_no, *cols)
    names = [h.lower() for h in header if h != "TRACK_ID"]
    out = last_per_group(rows, ["track_id"], F.col(line_no), names)
    return out.withColumn("year", year("releasedate") if "releasedate" in names else F.lit(""))


def join_metadata(catalog: DataFrame, meta: DataFrame, present: DataFrame | None = None, path: str = "path") -> DataFrame:
    """catalog with the metadata of its track_id ('' where missing), only of tracks whose path is in present, if given."""
    if present is not None:
        catalog = catalog.join(present.select(F.col("path").alias("__p")).distinct(), F.col(path) == F.col("__p"), "left_semi")
    extra = [c for c in meta.columns if c not in catalog.columns]
    joined = catalog.join(meta.select("track_id", *extra), "track_id", "left")
    return joined.select(*catalog.columns, *(F.coalesce(c, F.lit("")).alias(c) for c in extra))


def tracks_of_artists(catalog: DataFrame, artist: str, order: str) -> DataFrame:
    """(artist, tracks): each artist's tracks in order, as structs with a key, the path without its extension.

    The lists are as long as an artist's catalog; use it for chosen artists, not to regroup everything.
    """
    from tonearm.functions.paths import strip_extension

    item = F.struct(F.col(order).alias("at"), "track_id", "album_id", "path", strip_extension("path").alias("key"), "duration")
    return catalog.groupBy(artist).agg(F.array_sort(F.collect_list(item)).alias("tracks"))


def token_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """lines with tokens (ints) and id, the last token as text; blank lines have null and no tokens."""
    parts = F.filter(F.split(F.trim(line), r"\s+"), lambda x: x != "")
    own = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    return lines.withColumns({"id": F.try_element_at(parts, F.lit(-1)), "tokens": F.transform(own, lambda x: x.try_cast("int"))})


def first_queries(lines: DataFrame, n: int, line_no: str = "line_no", line: str = "value") -> DataFrame:
    """(prompt_id, query_index, source_index, num_tokens, value) of the first n lines; blank ones use up a number and give no row."""
    from tonearm.functions.scalar import padded, token_count

    some = lines.where(F.col(line_no) < n).where(F.trim(line) != "")
    return some.select(padded("query_", line_no, 4).alias("prompt_id"), F.col(line_no).alias("query_index"), F.col(line_no).alias("source_index"), token_count(line).alias("num_tokens"), line)


def integers(lines: DataFrame, line: str = "value") -> DataFrame:
    """(value) of all integers between commas and line ends; blanks are ignored, anything else is an error."""
    parts = F.filter(F.transform(F.split(line, ","), lambda x: F.trim(x)), lambda x: x != "")
    return lines.select(F.explode(parts).alias("value")).select(F.col("value").cast("bigint").alias("value"))


def manifest_items(spark: SparkSession, path: str) -> DataFrame:
    """The items of a prompt manifest, one row each."""
    doc = spark.read.schema(PROMPT_MANIFEST).option("multiLine", True).json(path)
    return doc.select(F.explode("items").alias("i")).select("i.*")


def prompt_of_query(given: Column, filename: Column) -> Column:
    """A query's prompt id as text: the given one, else the number after query_ without leading zeros, else the file name."""
    number = F.regexp_extract(filename, "query_([0-9]+)", 1).try_cast("bigint").cast("string")
    return F.coalesce(F.when(given != "", given), number, filename)


def with_fallback_path(samples: DataFrame, path: str, track: str, present: DataFrame) -> DataFrame:
    """samples with found, the first that is present of: the path, NN/id.2min.mp3, NN/id.mp3; null if none is.

    present: (path) of the files there are. Three lookups, none of which multiplies rows.
    """
    from tonearm.functions.scalar import shard_path

    there = present.select(F.col("path").alias("__p")).distinct()
    out = samples
    for i, c in enumerate((F.col(path), shard_path(track, ".2min.mp3"), shard_path(track, ".mp3"))):
        out = out.withColumn(f"__c{i}", c).join(there.withColumnRenamed("__p", f"__p{i}"), F.col(f"__c{i}") == F.col(f"__p{i}"), "left")
    return out.select(*samples.columns, F.coalesce("__p0", "__p1", "__p2").alias("found"))
