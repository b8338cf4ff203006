"""Writing tables: files with a fixed order of columns, documents, lines, and folders per model."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, columns: Sequence[str], mode: str = "overwrite") -> None:
    """CSV with a header and the columns in this order."""
    df.select(*columns).write.mode(mode).option("header", True).csv(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A JSON document per line."""
    df.write.mode(mode).json(path)


def json_text(*columns: Column | str) -> Column:
    """The columns as one JSON document; nulls are kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def write_document(row: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The first row as one JSON document."""
    row.limit(1).select(json_text(*row.columns).alias("value")).coalesce(1).write.mode(mode).text(path)


def write_lines(df: DataFrame, column: str, path: str, mode: str = "overwrite") -> None:
    """One value a line, sorted; as many files as the sort has partitions, in order of their names."""
    df.select(F.col(column).cast("string").alias("value")).orderBy("value").write.mode(mode).text(path)


def write_if_absent(df: DataFrame, path: str) -> None:
    """Parquet, unless something is there already, so that a phase can be run again."""
    df.write.mode("ignore").parquet(path)


def write_per_model(rows: DataFrame, path: str, model: str = "model_id", mode: str = "overwrite") -> None:
    """A folder of parquet per model; the rows of a model come from many tasks."""
    rows.write.mode(mode).partitionBy(model).parquet(path)


def write_matrix(scores: DataFrame, path: str, query: str = "query", queries_per_block: int = 1024, mode: str = "overwrite") -> None:
    """A coordinate table partitioned by blocks of queries."""
    scores.withColumn("query_block", F.floor(F.col(query) / queries_per_block)).write.mode(mode).partitionBy("query_block").parquet(path)


def write_dedup(pairs: DataFrame, paths: DataFrame, failures: DataFrame, root: str) -> None:
    """The outputs of a dedup under root: exclude (paths to drop), pairs, failures and summary. pairs: (drop, keep, similarity);
    paths: (id, path, relpath).
    """
    from tonearm.storage import cut

    held = cut(pairs, "pairs")
    d = paths.select(F.col("id").alias("drop"), F.col("path").alias("drop_path"), F.col("relpath").alias("drop_relpath"))
    k = paths.select(F.col("id").alias("keep"), F.col("path").alias("keep_path"), F.col("relpath").alias("keep_relpath"))
    named = held.join(d, "drop").join(k, "keep").select("keep_path", "keep_relpath", "drop_path", "drop_relpath", "similarity")
    write_lines(named.select("drop_path").distinct(), "drop_path", f"{root}/exclude")
    write_jsonl(named, f"{root}/pairs")
    write_jsonl(failures, f"{root}/failures")
    counts = held.agg(F.count(F.lit(1)).alias("n_pairs"), F.count_distinct("drop").alias("n_dropped"), F.count_distinct("keep").alias("n_kept_for"))
    write_document(counts, f"{root}/summary")


def write_pairwise(left: DataFrame, right: DataFrame, order: tuple[Sequence[str], Sequence[str]], path: str, columns: Sequence[str]) -> None:
    """CSV of two tables side by side, row by row in the order of each, as far as the shorter goes; index is the position."""
    from tonearm.operators.catalog import sequence_numbers

    a, b = (sequence_numbers(df, list(by), "index") for df, by in zip((left, right), order))
    write_csv(a.join(b, "index"), path, ["index", *columns])


def _shards(path: str, names: Sequence[str]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tonearm.sources.files import _store

        done, now, tar, stream = [], None, None, None
        for b in batches:
            keys, shards = b.column("__key").to_pylist(), b.column("__shard").to_pylist()
            contents = {n: b.column(n).to_pylist() for n in names}
            for i, (key, shard) in enumerate(zip(keys, shards)):
                if shard != now:
                    if tar is not None:
                        tar.close()
                        stream.close()
                    store, at, _ = _store(f"{path}/{shard:06d}.tar")
                    stream = store.open_output_stream(at)
                    tar, now = tarfile.open(fileobj=stream, mode="w|"), shard
                    done.append(shard)
                for n in names:
                    if (content := contents[n][i]) is not None:
                        info = tarfile.TarInfo(f"{key}.{n}")
                        info.size = len(content)
                        tar.addfile(info, io.BytesIO(content))
        if tar is not None:
            tar.close()
            stream.close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.int64())], ["shard"])

    return rows


def write_shards(df: DataFrame, path: str, key: str, fields: Sequence[str], shards: int) -> int:
    """Tar shards under path, an existing folder all executors share: one sample a row, with a member key.field for each binary
    field that isn't null. All rows of a shard are written by one task, which streams them; the number of shards written.
    """
    cols = [F.col(key).cast("string").alias("__key"), F.pmod(F.xxhash64(key), F.lit(shards)).alias("__shard"), *(F.col(f).cast("binary").alias(f) for f in fields)]
    rows = df.select(*cols).repartition(shards, "__shard").sortWithinPartitions("__shard", "__key")
    return len({r.shard for r in rows.mapInArrow(_shards(path, list(fields)), "shard bigint").collect()})


def subset_manifest(records: DataFrame, order: Sequence[str], pool_index: str | None = None) -> DataFrame:
    """records as a manifest: pool_index given, or by position, then the six fields of a record."""
    from tonearm.operators.catalog import sequence_numbers

    rows = records.withColumnRenamed(pool_index, "pool_index") if pool_index else sequence_numbers(records, list(order), "pool_index")
    return rows.select("pool_index", "global_index", "dataset_id", "dataset_root", "track_id", "path", "relpath")


def sample_id(rank: Column, batch: Column, item: Column) -> Column:
    """A sample's id from three numbers of fixed width."""
    return F.format_string("%03d%06d%04d", rank, batch, item)
