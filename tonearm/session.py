"""Session defaults. Everything here is a default: a cluster's own settings win."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g", shared: str | None = None) -> SparkSession:
    """A local session for tests and benches; clusters bring their own. shared: the folder of cut tables."""
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    builder = SparkSession.builder.master(f"local[{cores}]").config(map=DEFAULTS)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    session = builder.config("spark.driver.memory", memory).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A parquet table of a data directory; Catalyst pushes filters and columns into the scan."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
