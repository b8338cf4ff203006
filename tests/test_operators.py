from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tonearm import checks
from tonearm.operators import catalog as ct
from tonearm.operators import codebooks as cb
from tonearm.operators import matching as mt
from tonearm.operators import ranking as rk
from tonearm.operators import sampling as sm


def test_modal_value_ties_go_to_the_first_seen(spark):
    rows = [("x", "b", 1), ("x", "a", 2), ("x", "a", 3), ("x", "b", 4), ("y", None, 5), (None, "c", 6)]
    df = spark.createDataFrame(rows, "k string, g string, n int").withColumns({"al": F.lit(1), "d": F.lit(2.0)})
    got = {r.k: r for r in ct.contributor_summary(df, df, "k", "al", "d", "g", ["n"]).collect()}
    assert (got["x"].primary_genre, got["x"].genre_coherence, got["x"].n_unique_genres) == ("b", 0.5, 2)
    assert (got["y"].primary_genre, got["y"].genre_coherence, got["y"].n_unique_genres) == ("unknown", 0.0, 0)
    assert got[None].primary_genre == "c"


def _quotas(quotas, caps, seats):
    given = {b: min(q, caps[b]) for b, q in quotas.items()}
    while sum(given.values()) < seats:
        free = [b for b in quotas if given[b] < caps[b]]
        given[max(free, key=lambda b: (quotas[b] / (given[b] + 1), -list(quotas).index(b)))] += 1
    return given


def test_quotas():
    rng = random.Random(1)
    for _ in range(300):
        quotas = {b: rng.randrange(8) for b in "abcd"}
        caps = {b: rng.randrange(12) for b in "abcd"}
        low, high = sum(min(quotas[b], caps[b]) for b in quotas), sum(caps.values())
        seats = rng.randint(low, high) if low <= high else low
        assert ct.reconcile_quotas(quotas, caps, seats) == _quotas(quotas, caps, seats)
        with pytest.raises(ValueError):
            ct.reconcile_quotas(quotas, caps, high + 1)


def test_tiers_are_right_closed(spark):
    df = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "n int")
    assert [r.tier for r in ct.terciles(df, "n").orderBy("n").collect()] == ["low", "low", "mid", "high"]


def test_prompt_grid(spark):
    s = spark.createDataFrame([("a",), ("b",), ("c",)], "s string")
    got = ct.prompt_grid(s, "s", 3, 10, ["t1", "t2"], ["c1"]).collect()
    assert sum(r.kind == "on_genre" for r in got) == 9 and sorted(r.prompt_no for r in got) == list(range(1, 11))
    with pytest.raises(ValueError):
        ct.prompt_grid(s, "s", 3, 3, ["t"], ["c"])


def test_include_and_exclude(spark):
    files = spark.createDataFrame([("/r/a/1.mp3", 1), ("/r/a/1.mp3", 2), ("/r/b/1.mp3", 3), ("/r/c/2.wav", 4), (None, 5)], "path string, k int")
    none = spark.createDataFrame([], "entry string")
    assert mt.exclude(files, "path", none).count() == 5 and mt.include(files, "path", none).count() == 5
    for entry, hit in (("/r/a/1.mp3", {1, 2}), ("1.mp3", {1, 2, 3}), ("1", {1, 2, 3}), ("a/1.mp3", {1, 2}), ("a/1", {1, 2}), ("zzz", set())):
        e = spark.createDataFrame([(entry,)], "entry string")
        assert {r.k for r in mt.include(files, "path", e, ["/r"]).collect()} == hit
        assert {r.k for r in mt.exclude(files, "path", e, ["/r"]).collect()} == {1, 2, 3, 4, 5} - hit
    lines = spark.createDataFrame([("# no",), ("",), (" ./a//b ",), ("a/b",), (None,)], "l string")
    assert [r.entry for r in mt.clean_entries(lines, "l").collect()] == ["a/b"]


def test_priority_match(spark):
    left = spark.createDataFrame([(1, ["p", "n"]), (2, ["q", "n"]), (3, ["z"]), (4, [None]), (5, None)], "id int, ks array<string>")
    right = spark.createDataFrame([(10, ["n"], 1), (11, ["p", "n"], 2), (12, ["p"], 3), (13, [None], 4)], "s int, ks array<string>, o int")
    got = lambda last: {r.id: (r.key_no, r.s) for r in mt.priority_match(left, "id", F.col("ks"), right, F.col("ks"), [F.col("o")], ["s"], last).collect()}
    assert got(False) == {1: (0, 11), 2: (1, 10)}
    assert got(True) == {1: (0, 12), 2: (1, 11)}


def test_override_and_codes(spark):
    base = spark.createDataFrame([(1, "a", 2), (2, "b", 3)], "k int, v string, w int")
    new = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "k int, v string")
    assert sorted(tuple(r) for r in mt.override(base, new, ["k"]).collect()) == [(1, "x", 2), (2, "b", 3)]
    df = spark.createDataFrame([(None,), (1,), (9,)], "n int")
    assert [r[0] for r in df.select(mt.gate_code(F.col("n") > 5, F.col("n") > 0)).collect()] == [0, 2, 1]
    used, skipped = mt.size_split(df, "n", 5)
    assert used.count() == 2 and skipped.first().reason == "larger than 5"


def test_rankings(spark):
    df = spark.createDataFrame([("q", i, s) for i, s in enumerate([1.0, 5.0, 5.0, 2.0, None])], "q string, t int, s double")
    assert [r.t for r in rk.ranked_by_score(df, "q", "t", "s", 2).orderBy("rank").collect()] == [2, 1]
    p = spark.createDataFrame([("q", i, x) for i, x in enumerate([0.5, 0.3, 0.1, 0.1])], "q string, i int, p double")
    assert sorted(r.i for r in rk.nucleus(p, ["q"], "p", "i", 0.5).collect()) == [0, 1]
    assert sorted(r.i for r in rk.nucleus(p, ["q"], "p", "i", 0.45).collect()) == [0]
    assert sorted(r.i for r in rk.top_k_choice(p, ["q"], "p", 3).collect()) == [0, 1, 2, 3]
    cdf = rk.empirical_cdf(df, "s").orderBy("s").collect()
    assert [(r.s, r.n, r.cdf) for r in cdf] == [(1.0, 1, 0.25), (2.0, 1, 0.5), (5.0, 2, 1.0)]


def _table(layout):
    return {(r.step, r.book): r.frame for r in layout.collect()}


def test_layouts(spark):
    assert _table(cb.delayed(spark, 3, 4)) == {(1 + t + q, q): t for t in range(4) for q in range(3)}
    assert _table(cb.unrolled(spark, 3, 4)) == {(1 + 3 * t + q, q): t for t in range(4) for q in range(3)}
    part = _table(cb.unrolled(spark, 3, 4, [0, 1, 1]))
    assert part == {(1 + 2 * t + (q > 0), q): t for t in range(4) for q in range(3)}
    late = _table(cb.unrolled(spark, 3, 4, [0, 1, 1], [0, 3, 3]))
    assert [late.get((s, 0)) for s in (1, 2, 3, 5)] == [0, 1, 2, 3] and late[(4, 1)] == 0 and sorted(t for (_, q), t in late.items() if q == 1) == [0, 1, 2, 3]
    flat = _table(cb.delayed(spark, 2, 4, [0, 1], flatten_first=2, empty_initial=1))
    assert [flat[(2 + i, i % 2)] for i in range(4)] == [0, 0, 1, 1] and flat[(6, 0)] == 2 and flat[(7, 1)] == 2
    with pytest.raises(ValueError):
        cb.unrolled(spark, 2, 2, [0, 0], [0, 1])


def test_build_and_revert(spark):
    codes = spark.createDataFrame([(i, q, t, 100 * q + t) for i in range(2) for q in range(3) for t in range(5)], "id int, book int, frame int, code int")
    for layout in (cb.delayed(spark, 3, 5), cb.parallel(spark, 3, 5), cb.unrolled(spark, 3, 5), cb.coarse_first(spark, 3, 5), cb.grouped(spark, 3, 5, 1)):
        built = cb.build(codes, layout, 3, -1)
        assert built.where("step = 0 and code <> -1").count() == 0
        back = {tuple(r) for r in cb.revert(built, layout, -1).collect()}
        assert back == {tuple(r) for r in codes.collect()}
        cut = built.where("step > 0").withColumn("step", F.col("step") - 1)
        assert {tuple(r) for r in cb.revert(cut, layout, -1, model_output=True).collect()} == back


def test_masks_and_draws(spark):
    df = spark.range(400).select("id", (F.col("id") % 30).cast("int").alias("real"))
    rows = df.select("real", sm.inpaint_mask(F.col("id"), F.lit(30), F.col("real"), 2, (0.5, 0.0, 0.5)).alias("m"), sm.logsnr_time(1, F.col("id")).alias("t"), sm.normal(4, F.col("id")).alias("z")).collect()
    assert all(len(r.m) == 30 and all(x == 1 for x in r.m[r.real :]) for r in rows)
    assert all(1e-4 <= r.t <= 1 - 1e-4 for r in rows)
    z = [r.z for r in rows]
    assert abs(sum(z) / 400) < 0.2 and 0.8 < sum(x * x for x in z) / 400 < 1.2
    assert all(set(r.m) == {0} for r in df.select(sm.inpaint_mask(F.col("id"), F.lit(30), F.col("real"), 2, (0.0, 1.0, 0.0)).alias("m")).collect())


def test_stratified_draw_is_seeded(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(100)], "k int, band string")
    a, b = (sorted(r.k for r in ct.stratified_draw(df, "band", "k", {"a": 5, "b": 0}, s).collect()) for s in (1, 1))
    assert a == b and len(a) == 5 and all(k % 2 == 0 for k in a)
    assert ct.fraction_subset(df.limit(3), "k", 0.1, 0).count() == 1


def test_checks(spark):
    df = spark.createDataFrame([(1, 2), (1, 3)], "a int, b int")
    checks.require_columns(df, ["a"])
    for bad in (
        lambda: checks.require_columns(df, ["c"]),
        lambda: checks.require_header("A\tC", ["A", "B"]),
        lambda: checks.require_same_rows(df, df.limit(1)),
        lambda: checks.require_range(df, "b", 0, 3),
        lambda: checks.require_unique(df, ["a"]),
        lambda: checks.require_same_axis(df, "b", "a", "b"),
        lambda: mt.require_all(df, "b", 3),
        lambda: mt.require_single(df, "b"),
    ):
        with pytest.raises(ValueError):
            bad()
