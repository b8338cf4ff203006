"""Listings of files as tables: recursive scans by extension and keyword, roots from configurations, numbered folders."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.functions.ids import basename
from tonearm.functions.paths import relpath, suffix
from tonearm.schemas import DATASET_CONFIG
from tonearm.storage import cut

# Fixed value: names that mark leftovers of archives.
BANNED = ["paxheader", "__macosx"]
# Fixed value: extensions of audio files.
AUDIO = [".wav", ".mp3", ".flac", ".ogg", ".aif", ".opus"]
TARS = [".tar", ".tgz", ".gz"]


def parse_extensions(text: str) -> list[str]:
    """Extensions of a comma list: trimmed, lower case, with a dot, each once; an error if there is none."""
    out = list(dict.fromkeys("." + e.strip().lower().lstrip(".") for e in text.split(",") if e.strip().lstrip(".")))
    if not out:
        raise ValueError("no extension given")
    return out


def parsed_extensions(c: Column | str) -> Column:
    """The same for a column."""
    parts = F.transform(F.split(F.lower(c), ","), lambda e: F.regexp_replace(F.trim(e), r"^\.+", ""))
    return F.array_distinct(F.transform(F.filter(parts, lambda e: e != ""), lambda e: F.concat(F.lit("."), e)))


def _store(uri: str):
    """(file system, path in it, what stands before the path in a URI) of a folder, from within a task."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri, ""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/"), ""
    scheme, rest = uri.split("://", 1)
    store, at = fs.FileSystem.from_uri(f"s3://{rest}" if scheme in ("s3a", "s3n") else uri)
    return store, at, f"{scheme}://{rest[: len(rest) - len(at)]}" if rest.endswith(at) else f"{scheme}://"


def _children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the folders of a batch hold; folders that are missing or can't be read hold nothing."""
    from pyarrow import fs

    for b in batches:
        path, size, folder = [], [], []
        for uri in b.column(0).to_pylist():
            try:
                store, at, before = _store(uri)
                found = store.get_file_info(fs.FileSelector(at, allow_not_found=True))
            except OSError:
                continue
            for i in found:
                if i.type in (fs.FileType.File, fs.FileType.Directory):
                    path.append(before + i.path)
                    size.append(i.size if i.type == fs.FileType.File else None)
                    folder.append(i.type == fs.FileType.Directory)
        yield pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(size, pa.int64()), pa.array(folder, pa.bool_())], ["path", "size", "folder"])


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, size) of all files below root, listed level by level by the executors, so that the driver holds no names.

    A root that doesn't exist gives no row.
    """
    tasks = spark.sparkContext.defaultParallelism
    level = spark.createDataFrame([(root.rstrip("/") or "/",)], "path string").coalesce(1)
    out = None
    while True:
        found = cut(level.mapInArrow(_children, "path string, size bigint, folder boolean"), "listing")
        files = found.where("not folder").select("path", "size")
        out = files if out is None else out.union(files)
        level = found.where("folder").select("path")
        if level.isEmpty():
            return out
        level = level.repartition(tasks, "path")


def scan(spark: SparkSession, root: str, extensions: Sequence[str], keywords: Sequence[str] = ()) -> DataFrame:
    """(path, size) of files below root with one of the extensions (with or without dot), in any case; files whose name begins
    with a dot are left out.

    With keywords, only files whose name has one of them and none of the names of archive leftovers. Only names and sizes
    are read. A root that doesn't exist gives no row.
    """
    files = listing(spark, root)
    name = F.lower(basename("path"))
    ok = suffix("path").isin(["." + e.lower().removeprefix(".") for e in extensions]) & ~F.startswith(name, F.lit("."))
    if keywords:
        ok = ok & F.exists(F.array(*(F.lit(k.lower()) for k in keywords)), lambda k: F.contains(name, k))
        ok = ok & ~F.exists(F.array(*(F.lit(b) for b in BANNED)), lambda b: F.contains(name, b))
    return files.where(ok)


def scan_roots(spark: SparkSession, roots: Sequence[str], extensions: Sequence[str] = AUDIO, keywords: Sequence[str] = ()) -> DataFrame:
    """(path, size, root) of all roots one after the other; a file below two roots is listed twice."""
    out = None
    for root in roots:
        one = scan(spark, root, extensions, keywords).withColumn("root", F.lit(root))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "path string, size bigint, root string")


def discover(spark: SparkSession, roots: Sequence[str], extensions: Sequence[str] = AUDIO) -> DataFrame:
    """(path, root, relpath), sorted by path."""
    return scan_roots(spark, roots, extensions).select("path", "root", relpath("path", F.regexp_replace("root", "^file:/+", "/")).alias("relpath")).orderBy("path")


def latents(spark: SparkSession, root: str, extensions: Sequence[str]) -> DataFrame:
    """(path) of the files that filelist.txt in the root names, if there is one; of a scan otherwise."""
    listed = f"{root.rstrip('/')}/filelist.txt"
    if exists(spark, listed):
        return spark.read.text(listed).select(F.concat(F.lit(root.rstrip("/") + "/"), F.trim("value")).alias("path"))
    return scan(spark, root, extensions).select("path")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, in whatever file system it is."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def roots_of_config(spark: SparkSession, path: str) -> list[str]:
    """The data folders of a configuration document; an error unless its type is audio_dir."""
    row = spark.read.schema(DATASET_CONFIG).option("multiLine", True).json(path).first()
    if row is None or row.dataset_type != "audio_dir":
        raise ValueError("only configurations of type audio_dir name folders")
    return [d.path for d in row.datasets or [] if d.path]


def largest_first(spark: SparkSession, root: str, extensions: Sequence[str], limit: int | None, most_bytes: int) -> DataFrame:
    """(idx, path, size, too_large) of the first limit files by path."""
    from tonearm.operators.catalog import sequence_numbers

    files = scan(spark, root, extensions)
    files = files.orderBy("path").limit(limit) if limit is not None else files
    return sequence_numbers(files, ["path"]).select("idx", "path", "size", (F.col("size") > most_bytes).alias("too_large"))


def numbered_folders(paths: DataFrame, path: str) -> DataFrame:
    """(model_id, path) of the paths whose last segment is a number, in order of the number."""
    name = basename(F.regexp_replace(path, "/+$", ""))
    return paths.where(name.rlike("^[0-9]+$")).select(name.cast("int").alias("model_id"), path).orderBy("model_id")


def objects(spark: SparkSession, uris: Sequence[str], extensions: Sequence[str]) -> DataFrame:
    """(path, size) of objects of a store by their URIs (s3a and the like), through the file system Spark has for them."""
    return scan_roots(spark, [unquote(u) for u in uris], extensions).drop("root")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The samples of the shards of a batch, read from the file system as a stream, one sample held at a time."""
    import tarfile

    kind = pa.map_(pa.string(), pa.binary())

    def row(shard: str, key: str, fields: dict[str, bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([key]), pa.array([list(fields.items())], kind)], ["shard", "key", "fields"])

    for b in batches:
        for shard in b.column(0).to_pylist():
            store, at, _ = _store(shard)
            key, fields = None, {}
            with store.open_input_stream(at) as stream, tarfile.open(fileobj=stream, mode="r|*") as tar:
                for m in tar:
                    if not m.isfile() or m.name.startswith("/") or ".." in m.name.split("/"):
                        continue
                    folder, name = os.path.split(m.name)
                    stem, _, field = name.partition(".")
                    own = os.path.join(folder, stem)
                    if key is not None and own != key:
                        yield row(shard, key, fields)
                        fields = {}
                    key = own
                    fields[field] = tar.extractfile(m).read()
            if key is not None:
                yield row(shard, key, fields)


def members(spark: SparkSession, shards: str) -> DataFrame:
    """(shard, key, fields) of the tar shards of a folder, or of one shard: neighbouring members with the same name up to its
    first dot are one sample, fields maps the rest of the name to the bytes. Members with unsafe names are left out.

    Each shard is streamed by one task, which holds a sample at a time, so a shard may be of any size.
    """
    if suffix_of(shards) in TARS:
        paths = spark.createDataFrame([(shards,)], "path string")
    else:
        paths = scan(spark, shards, TARS).select("path").orderBy("path")
    tasks = spark.sparkContext.defaultParallelism
    return paths.repartition(tasks, "path").mapInArrow(_members, "shard string, key string, fields map<string, binary>")


def suffix_of(path: str) -> str:
    """The last suffix of a path, lower case."""
    return os.path.splitext(path)[1].lower()
