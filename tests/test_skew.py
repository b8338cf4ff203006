from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tonearm.operators.skew import chunks, dominant_keys, hot_keys, join_unique, number_rows, ordered_stats, salted_join


def _rows(seed: int, n: int = 3000):
    rng = random.Random(seed)
    return [(rng.choice([1, 1, 1, 1, 2, 3, None]) if rng.random() < 0.7 else rng.randrange(50), i if rng.random() < 0.9 else None, rng.choice(["a", "b", None]), rng.choice([None, 1, 2])) for i in range(n)]


def test_numbers_are_exact(spark):
    rows = _rows(1)
    got = number_rows(spark.createDataFrame(rows, "k int, o int, v string, a int"), ["k"], ["o"]).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.k].append((r.row_no, -1 if r.o is None else r.o))
    for k, pairs in by.items():
        pairs.sort()
        assert [p for p, _ in pairs] == list(range(1, sum(x[0] == k for x in rows) + 1))
        assert [o for _, o in pairs] == sorted(o for _, o in pairs)


def test_repeated_rows_are_each_numbered(spark):
    df = spark.createDataFrame([(1, 5)] * 40 + [(2, 5)] * 3, "k int, o int")
    got = Counter((r.k, r.row_no) for r in number_rows(df, ["k"], ["o"]).collect())
    assert set(got.values()) == {1} and len(got) == 43


def test_chunks_are_of_equal_size(spark):
    sizes = Counter((r.k, r.chunk_no) for r in chunks(spark.createDataFrame([(1, i) for i in range(1000)], "k int, o int"), ["k"], ["o"], 64).collect())
    assert sorted(sizes.values())[0] == 1000 % 64 and set(sorted(sizes.values())[1:]) == {64}


@pytest.mark.parametrize("chunk_rows", [1, 7, 10_000])
def test_ordered_stats(spark, chunk_rows):
    rows = [r for r in _rows(2, 800) if r[1] is not None]
    got = {r.k: r for r in ordered_stats(spark.createDataFrame(rows, "k int, o int, v string, a int"), "k", "o", "v", "a", chunk_rows).collect()}
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    assert set(got) == set(by)
    for k, rs in by.items():
        rs.sort(key=lambda r: r[1])
        g = got[k]
        gaps = [b[1] - a[1] for a, b in zip(rs, rs[1:])]
        assert (g.n_rows, g.n_chunks, g.first_at, g.last_at) == (len(rs), -(-len(rs) // chunk_rows), rs[0][1], rs[-1][1])
        assert g.max_gap == (max(gaps) if gaps else None)
        assert g.n_changes == sum(a[2] != b[2] for a, b in zip(rs, rs[1:]))
        assert (g.total_amount or 0) == sum(r[3] or 0 for r in rs)


def test_dominant_keys(spark):
    df = spark.createDataFrame([(1, i) for i in range(98)] + [(2, 98)] + [(None, 99)], "k int, o int")
    assert [tuple(r) for r in dominant_keys(df, "k", "o", 0.02).collect()] == [(1, 98)]
    assert sorted(r.k for r in dominant_keys(df, "k", "o", 0.01).collect()) == [1, 2]
    assert dominant_keys(df.limit(0), "k", "o", 0.5).count() == 0


def test_clashing_columns_are_refused(spark):
    with pytest.raises(ValueError):
        number_rows(spark.createDataFrame([(1, 2)], "k int, row_no int"), ["k"], ["row_no"])


def test_a_hot_key_spans_partitions(spark):
    rows = [(1.0, i % 50, "a" if i % 3 else None) for i in range(5000)] + [(float("nan"), i, "b") for i in range(9)] + [(None, 3, "c")]
    got = number_rows(spark.createDataFrame(rows, "k double, o int, v string"), ["k"], ["o"]).collect()
    by = defaultdict(list)
    for r in got:
        by["nan" if r.k is not None and r.k != r.k else r.k].append((r.row_no, r.o))
    assert {k: len(v) for k, v in by.items()} == {1.0: 5000, "nan": 9, None: 1}
    for pairs in by.values():
        pairs.sort()
        assert [p for p, _ in pairs] == list(range(1, len(pairs) + 1)) and [o for _, o in pairs] == sorted(o for _, o in pairs)


def test_joins_of_hot_keys(spark):
    df = spark.createDataFrame([(1, i) for i in range(500)] + [(i, i) for i in range(2, 60)] + [(None, -1)], "k int, o int")
    table = spark.createDataFrame([(i, f"v{i}") for i in range(0, 40)], "k int, v string")
    assert [r.k for r in hot_keys(df, ["k"], df.count(), 100).collect()] == [1]
    for how in ("left", "inner"):
        want = sorted(map(str, df.join(table, "k", how).select("k", "o", "v").collect()))
        assert sorted(map(str, join_unique(df, table, "k", how, 100).select("k", "o", "v").collect())) == want


def test_joins_of_keys_hot_on_both_sides(spark):
    a = spark.createDataFrame([(1, i) for i in range(90)] + [(2, i) for i in range(60)] + [(i, i) for i in range(3, 40)] + [(None, -1)], "k int, x int")
    b = spark.createDataFrame([(1, i) for i in range(70)] + [(3, i) for i in range(80)] + [(i, i) for i in range(2, 40)] + [(None, -1)], "k int, y int")
    want = sorted(map(str, a.join(b, "k").select("k", "x", "y").collect()))
    assert sorted(map(str, salted_join(a, b, "k", 20).select("k", "x", "y").collect())) == want
    assert sorted(map(str, salted_join(a, b, "k").select("k", "x", "y").collect())) == want


def test_joins_by_several_keys_with_nulls(spark):
    rows = [(1, None, i) for i in range(80)] + [(None, 2, i) for i in range(70)] + [(i, i % 3, i) for i in range(40)]
    df = spark.createDataFrame(rows, "a int, b int, x int")
    table = df.groupBy("a", "b").count()
    for floor in (20, 10**6):
        got = sorted(map(str, join_unique(df, table, ["a", "b"], "inner", floor, null_safe=True).collect()))
        per = Counter((a, b) for a, b, _ in rows)
        assert got == sorted(f"Row(a={a}, b={b}, x={x}, count={per[a, b]})" for a, b, x in rows)
        plain = join_unique(df, table, ["a", "b"], "left", floor)
        assert plain.count() == len(rows) and plain.where("count is null").count() == 150


def test_names_of_columns_do_not_matter(spark):
    df = spark.createDataFrame([(1, 5, "a", 2), (1, 7, "b", 3), (2, 1, None, 4)], "n int, gap int, changes string, amount int").withColumn("row_no", F.lit(0))
    got = {r.n: (r.n_rows, r.max_gap, r.n_changes, r.total_amount) for r in ordered_stats(df, "n", "gap", "changes", "amount").collect()}
    assert got == {1: (2, 2, 1, 5), 2: (1, None, 0, 4)}
    with pytest.raises(ValueError):
        ordered_stats(df.withColumnRenamed("n", "n_rows"), "n_rows", "gap")
