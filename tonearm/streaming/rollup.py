"""Roll-ups of scores over event streams. An extension: windows with a watermark, late rows dropped after it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def event_stream(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """A stream of the event files of a folder."""
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).parquet(folder)


def windowed_sums(events: DataFrame, time: str, keys: list[str], value: str, width: str, late: str) -> DataFrame:
    """Count and sum per key and window; a window's state is dropped once the watermark passes it."""
    timed = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    out = timed.groupBy(F.window("__t", width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process all that is there into parquet and stop. Each batch writes the sums it changed, those of windows still open too,
    under its number; latest() reads them. Run again on the same checkpoint, open windows go on.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def latest(stream: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """The sums that run_to_table() wrote, each window and key as its last batch has it."""
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    groups = ["window_start", *keys]
    rest = [c for c in stream.columns if c not in groups]
    last = stream.sparkSession.read.schema(schema).parquet(path).groupBy(*groups).agg(F.max_by(F.struct(*rest), "batch").alias("__last"))
    return last.select(*(c if c in groups else F.col("__last")[c].alias(c) for c in stream.columns))
