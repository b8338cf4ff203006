"""The queries over all rows meet every row of their tables."""

from __future__ import annotations

from collections import defaultdict

from tonearm.plans import core_registry
from tonearm.plans.bases import scores

QUERIES = core_registry().queries


def test_all_rows_are_met(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    ids = [r.row_no for r in QUERIES["o07_restore_order"](spark, sf).collect()]
    assert ids == sorted(r.event_id for r in events.select("event_id").collect())
    k = "event_id % 11 = 3 or event_id % 5 <> 0"
    padded = QUERIES["t06_pad"](spark, sf).collect()
    assert sum(r.events for r in padded) == events.where("user_id is not null").where(k).count() and sum(r.rests for r in padded) > 0
    rows = scores(spark, sf).collect()
    sellers = defaultdict(set)
    for r in rows:
        sellers[r.train].add(r.seller)
    cents = sum(r.cents * len(sellers[r.train]) for r in rows)
    assert sum(r.value for r in QUERIES["a03_roll_up"](spark, sf).collect()) == cents
    assert sum(r.value for r in QUERIES["a04_signed_index_sums"](spark, sf).collect()) == -cents
