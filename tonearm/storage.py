"""Cutting lineage through tables in the folder that all executors share.

A cut table is plain parquet, so it is compressed, column-pruned on reading and survives the loss of any executor.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; an own temporary one only where it is unset and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="tonearm-")
    return "file://" + _OWN[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted by drop_cuts() with all below it."""
    path = f"{shared_dir(spark)}/tonearm-{uuid.uuid4().hex}/{name}"
    _WRITTEN.append((spark, path))
    return path


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df to the shared folder and return a scan of what was written (eager)."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cuts(before: int | None = None) -> None:
    """Delete the tables that cut() wrote, all of them or the first so many; results built on them must be consumed before."""
    n = len(_WRITTEN) if before is None else before
    for spark, path in _WRITTEN[:n]:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path.rsplit("/", 1)[0])
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the session may have ended; the folder is temporary
            pass
    del _WRITTEN[:n]


def _at_exit() -> None:
    import shutil

    drop_cuts()
    for path in _OWN.values():
        shutil.rmtree(path, ignore_errors=True)


atexit.register(_at_exit)
