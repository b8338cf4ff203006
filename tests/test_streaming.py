from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tonearm.streaming import rollup as ru


def test_the_query_sums_all_events(spark, sf):
    from tonearm.plans import core_registry

    got = core_registry().queries["stream_windowed_sums"](spark, sf)
    events = spark.read.parquet(f"{sf}/events.parquet")
    want = events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour")["start"].alias("window_start"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    plain = lambda df: {(r.window_start, r.event_type): (r.n, round(r.total, 6)) for r in df.collect()}
    assert got.agg(F.sum("n")).first()[0] == events.count()
    assert plain(got) == plain(want) and got.count() == want.count()


def test_open_windows_go_on_in_a_second_run(spark, tmp_path):
    def add(rows):
        at = [(i, datetime.datetime(2024, 1, 1, h, m), 1, t, v, "") for i, h, m, t, v in rows]
        spark.createDataFrame(at, ru.EVENTS).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")

    def run():
        s = ru.windowed_sums(ru.event_stream(spark, f"file://{tmp_path}/in"), "ts", ["event_type"], "value", "1 hour", "10 minutes")
        ru.run_to_table(s, f"file://{tmp_path}/out", f"file://{tmp_path}/state")
        return sorted((r.window_start.hour, str(r.event_type), r.n, r.total) for r in ru.latest(s, f"file://{tmp_path}/out", ["event_type"]).collect())

    add([(1, 1, 0, "a", 1.0), (2, 3, 5, "a", 2.0), (3, 3, 6, None, 4.0)])
    assert run() == [(1, "a", 1, 1.0), (3, "None", 1, 4.0), (3, "a", 1, 2.0)]
    add([(4, 3, 50, "a", 8.0)])
    assert run() == [(1, "a", 1, 1.0), (3, "None", 1, 4.0), (3, "a", 2, 10.0)]
