from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tonearm.llm import caps as cp


def _greedy(rows, levels):
    """The greedy choice of a laminar matroid: best first, taken if no cap forbids it."""
    taken, held = [], [dict() for _ in levels]
    for r in sorted(rows, key=lambda r: (-(r["q"] if r["q"] is not None and r["q"] >= 0 else -1), r["id"])):
        keys = [tuple(r[k] for k in ks) for ks, _ in levels]
        if all(None in k or h.get(k, 0) < cap for k, h, (_, cap) in zip(keys, held, levels)):
            taken.append(r["id"])
            for k, h in zip(keys, held):
                h[k] = h.get(k, 0) + 1
    return sorted(taken)


def test_nested_caps_are_greedy(spark, monkeypatch):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        author = rng.choice([*range(12), None])
        domain = None if author is None else author // 3
        rows.append({"id": i, "author": author, "domain": domain, "org": None if domain is None else domain // 2, "q": rng.choice([None, -1.0, 0.0, 0.5, 0.5, 0.9])})
    df = spark.createDataFrame(rows, "id int, author int, domain int, org int, q double")
    levels = [(["author", "domain", "org"], 6), (["domain", "org"], 11), (["org"], 17)]
    caps = [cp.Cap(ks, n) for ks, n in levels]
    order = [cp.quality_order("q"), F.col("id").asc()]
    assert sorted(r.id for r in cp.nested_caps(df, caps, order).collect()) == _greedy(rows, levels)
    monkeypatch.setattr(cp, "PUSHED_RANK", 2)
    assert sorted(r.id for r in cp.nested_caps(df, caps, order).collect()) == _greedy(rows, levels)


def test_shares_ties_and_edges(spark):
    df = spark.createDataFrame([(1, i, math.nan if i == 3 else 1.0, "x" * i) for i in range(10)] + [(None, 50, 1.0, ""), (None, 51, None, None)], "k int, id int, q double, n_group string")
    got = cp.nested_caps(df, [cp.Cap(["k"], max_share=0.25)], [cp.quality_order("q"), F.col("id").asc()])
    assert got.columns == df.columns and sorted(r.id for r in got.collect()) == [0, 1, 2, 50, 51]
    assert cp.nested_caps(df.limit(0), [cp.Cap(["k"], max_share=0.25)], [F.col("id").asc()]).count() == 0
    twice = df.where("id = 0").union(df.where("id = 0"))
    assert cp.nested_caps(twice, [cp.Cap(["k"], 1)], [F.col("id").asc()]).count() == 1
    assert cp.group_sizes(df, ["k"]).where("k = 1").first().n_group == 10


def test_bad_caps(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    with pytest.raises(ValueError):
        cp.nested_caps(df, [cp.Cap(["a"], 1), cp.Cap(["b"], 1)], [F.col("a")])
    with pytest.raises(ValueError):
        cp.nested_caps(df, [cp.Cap(["a"])], [F.col("a")])
    with pytest.raises(ValueError):
        cp.nested_caps(df.withColumn("__rank", F.lit(1)), [cp.Cap(["a"], 1)], [F.col("a")])


def test_best_are_chosen_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    plan = cp.nested_caps(df, [cp.Cap(["k"], 25)], [F.col("id").asc()])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_shares_are_taken_as_decimals():
    assert [cp.Cap(["k"], max_share=s).rows(100) for s in (0.29, 0.57, 0.58, 1.0, 0.001)] == [29, 57, 58, 100, 1]
