"""Operators against plain versions of themselves: percentiles, ranks, sums, packing, silence, draws, shards, user functions."""

from __future__ import annotations

import random
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tonearm.functions import arrays as ar
from tonearm.operators import catalog as ct
from tonearm.operators import ranking as rk
from tonearm.operators import sampling as sm
from tonearm.operators import stats as st
from tonearm.operators import tokens as tk
from tonearm.operators import vectors as vx
from tonearm.operators.skew import number_rows
from tonearm.sources import files, registry, sinks


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None, "c"]), rng.choice([None, *range(12)]) if i % 2 else rng.random() * 20, i) for i in range(700)] + [("one", 5.0, 900), ("none", None, 901)]
    rows = [(k, None if v is None else float(v), i) for k, v, i in rows]
    return rows, spark.createDataFrame(rows, "k string, v double, i int")


def test_percentiles(values):
    rows, df = values
    cuts = [0.0, 0.25, 1 / 3, 0.5, 0.9, 1.0]
    got = {r.k: r.p for r in st.percentiles(df, "v", cuts, ["k"]).collect()}
    own = {}
    for k, v, _ in rows:
        if v is not None:
            own.setdefault(k, []).append(v)
    assert set(got) == set(own)
    for k, vs in own.items():
        assert np.allclose(got[k], np.quantile(vs, cuts))
    assert np.allclose(st.percentiles(df, "v", cuts).first().p, np.quantile([v for _, v, _ in rows if v is not None], cuts))
    assert st.percentiles(df.limit(0), "v", cuts).count() == 0
    summary = {r.k: r for r in st.summary(df, "v", ["k"]).collect()}
    assert summary["none"].n == 0 and summary["none"].median is None and summary["one"].p75 == 5.0


@pytest.mark.parametrize("fits", [False, True])
def test_average_ranks(values, fits):
    rows, df = values
    some = df.where("v is not null")
    frame = pd.DataFrame([r for r in rows if r[1] is not None], columns=["k", "v", "i"])
    frame["k"] = frame["k"].fillna("null")
    for down in (False, True):
        frame["r"] = frame.groupby("k")["v"].rank(ascending=not down)
        got = {r.i: r.r for r in st.with_average_rank(some, "v", ["k"], "r", down, fits).collect()}
        assert got == dict(zip(frame["i"], frame["r"]))


def test_running_sums_and_nucleus(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 2]), i, rng.random()) for i in range(900)]
    df = spark.createDataFrame(rows, "k int, i int, p double")
    got = {r.i: r["__sum_p"] for r in number_rows(df, ["k"], ["i"], running=["p"]).collect()}
    upto = {1: 0.0, 2: 0.0}
    for k, i, p in rows:
        upto[k] += p
        assert abs(got[i] - upto[k]) < 1e-9
    kept = {(r.k, r.i): r.renormalised for r in rk.nucleus(df, ["k"], "p", "i", 20.0).collect()}
    for key in (1, 2):
        before, want = 0.0, []
        for _, i, p in sorted((r for r in rows if r[0] == key), key=lambda r: -r[2]):
            if before <= 20.0:
                want.append((i, p))
            before += p
        assert {i for k, i in kept if k == key} == {i for i, _ in want}
        assert abs(sum(v for (k, _), v in kept.items() if k == key) - 1) < 1e-9


def test_windows_with_separators_and_flags(spark):
    rng = random.Random(1)
    rows = []
    for at in range(14):
        aug, t, ev = at % 3 == 1, 0, []
        for _ in range(rng.randint(0, 40)):
            t += rng.randint(0, 1150)
            control = aug and rng.random() < 0.3
            up = tk.CONTROL if control else 0
            ev += [t + up, tk.DUR + 5 + up, tk.NOTE + rng.randrange(100) + up]
        rows.append((7, at, aug, ev))
    df = spark.createDataFrame(rows, "w int, at int, aug boolean, flat array<int>").withColumn("e", tk.pack("flat"))
    got = [(r.window_no, r.tokens) for r in tk.windows_of_piece(df, "w", "at", "e", 20, "aug", True).orderBy("window_no").collect()]

    off = lambda e: tk.CONTROL if e[2] >= tk.CONTROL and e[2] != tk.SEPARATOR else 0
    clock = lambda es: max((e[0] - off(e) for e in es if e[2] != tk.SEPARATOR), default=0)

    def shift(es, dt):
        out, on = [], True
        for e in es:
            on = on and e[2] != tk.SEPARATOR
            out.append([e[0] + dt, e[1], e[2]] if on else e)
        return out

    held, want, flag = [], [], None
    for _, _, aug, ev in rows:
        own = tk.ANTICIPATE if aug else tk.AUTOREGRESS
        flag = own if not held else flag
        es = [ev[i : i + 3] for i in range(0, len(ev), 3)]
        es = [[tk.SEPARATOR] * 3] + es if aug else es
        held = held + (shift(es, clock(held) + 10) if held else es)
        while len(held) >= 20:
            part, held = held[:20], held[20:]
            first = []
            for e in part:
                if e[2] == tk.SEPARATOR:
                    break
                first.append(e[0] - off(e))
            part = shift(part, -min(first, default=0))
            if clock(part) < tk.MAX_TIME:
                want.append([flag, *(x for e in part for x in e), 7])
                flag = own
            else:
                want.append(None)
    assert [t for _, t in got] == want and any(t is None for _, t in got) and any(t and t[0] == tk.ANTICIPATE for _, t in got)


def test_weaving_controls(spark):
    rng = random.Random(9)
    rows = []
    for i in range(40):
        ev = sorted([rng.randrange(3000), tk.DUR, tk.NOTE] for _ in range(rng.randint(0, 25)))
        co = sorted([tk.CONTROL + rng.randrange(4000), tk.CONTROL + tk.DUR, tk.CONTROL + tk.NOTE + j] for j in range(rng.randint(0, 12)))
        rows.append((i, [x for e in ev for x in e], [x for c in co for x in c]))
    df = spark.createDataFrame([*rows, (99, None, [])], "i int, a array<int>, b array<int>")
    tokens, left = tk.anticipate(tk.pack("a"), tk.pack("b"))
    got = {r.i: (r.t, r.l) for r in df.select("i", F.when(F.col("a").isNotNull(), tk.flat(tokens)).alias("t"), tk.flat(left).alias("l")).collect()}
    for i, a, b in rows:
        ev, co = [a[k : k + 3] for k in range(0, len(a), 3)], [b[k : k + 3] for k in range(0, len(b), 3)]
        out, now = [], 0
        for e in ev:
            while co and now >= co[0][0] - tk.CONTROL - tk.DELTA:
                out.append(co.pop(0))
            out.append(e)
            now = max(now, e[0])
        assert got[i] == ([x for e in out for x in e], [x for c in co for x in c]), i
    assert got[99][0] is None


def test_normal_quantiles(spark):
    ps = [1e-12, 1e-5, 0.01, 0.0242, 0.3, 0.5, 0.77, 0.99, 1 - 1e-7]
    df = spark.createDataFrame([(p,) for p in [*ps, 0.0, 1.0]], "p double")
    got = [r.z for r in df.select(sm.normal_quantile(F.col("p")).alias("z")).collect()]
    assert np.allclose(got[:-2], [NormalDist().inv_cdf(p) for p in ps], rtol=2e-8) and got[-2:] == [None, None]
    zs = spark.createDataFrame([(z,) for z in (-8.0, -4.9, -1.0, 0.0, 0.3, 4.0, 7.0)], "z double")
    for r in zs.select("z", sm.normal_distribution(F.col("z")).alias("p")).collect():
        assert abs(r.p - NormalDist().cdf(r.z)) < 1e-9
    ts = [r.t for r in spark.range(4000).select(sm.truncated_time(1, F.col("id")).alias("t")).collect()]
    assert min(ts) >= -1e-9 and max(ts) < 1 and abs(np.median(ts) - (1 / (1 + np.exp(-NormalDist().inv_cdf(0.5 + sm.bound_of(0.075) / 2))) - 0.075) / 0.925) < 0.02


def test_compacted_silence(spark):
    x = [1.0] * 3 + [0.0] * 10 + [1.0] + [0.0] * 2 + [1.0, 0.0, 0.0, 0.0, 0.0]
    df = spark.createDataFrame([(1, x), (2, [0.0] * 40), (3, []), (4, None)], "id int, s array<double>")
    got = {r.id: r.s for r in vx.compact_silence(df, "id", "s", 12, 0.01, 0.5, 0.25).collect()}
    assert got[1] == [1.0] * 3 + [0.0] * 6 + [1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0]
    assert got[2] == [0.0] * 6 and got[3] == [] and got[4] is None


def test_draws_of_cells_and_redrawn_rows(spark):
    df = spark.createDataFrame([(i, i) for i in range(20)], "k int, v int")
    got = ct.draw_cells(df, "k", "v", [{"band": "a", "high": 9, "count": 8}, {"band": "b", "low": 5, "count": 9}], 1).collect()
    assert len({r.k for r in got}) == 17 and sorted(r.draw_no for r in got) == list(range(1, 18))
    with pytest.raises(ValueError):
        ct.draw_cells(df, "k", "v", [{"band": "a", "high": 9, "count": 10}, {"band": "b", "low": 5, "high": 9, "count": 1}], 1)
    r = ct.redrawn(df, "k", F.col("v") >= 15, ["k"]).collect()
    assert len(r) == 20 and all(x.v >= 15 for x in r) and {x.drawn_for for x in r if x.drawn_for is not None} == set(range(15))
    assert ct.redrawn(df, "k", F.col("v") > 99, ["k"]).count() == 0


def test_ordered_map_needs_a_row_for_each(spark):
    df = spark.range(50)
    same = lambda batches: (b for b in batches)
    assert [r.idx for r in ct.ordered_map(df, [F.col("id").desc()], same, "id bigint").collect()] == list(range(50))
    fewer = lambda batches: (b.slice(1) for b in batches)
    with pytest.raises(Exception, match="row for each"):
        ct.ordered_map(df, ["id"], fewer, "id bigint").collect()


def test_shards_keep_samples(spark, tmp_path):
    rows = [(i, f"t{i}", None if i % 3 else f"j{i}") for i in range(30)]
    df = spark.createDataFrame(rows, "id int, txt string, json string")
    n = sinks.write_shards(df, str(tmp_path), "id", ["txt", "json"], 5)
    assert n == len(list(tmp_path.glob("*.tar"))) <= 5
    got = {r.key: {k: bytes(v).decode() for k, v in r.fields.items()} for r in files.members(spark, str(tmp_path)).collect()}
    assert got == {str(i): {"txt": t} | ({"json": j} if j else {}) for i, t, j in rows}


def test_user_functions_that_replace(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id int, a string")
    made = registry.apply_metadata(df, lambda c: {"__replace__": F.when(c["id"] == 1, F.lit("new")), "__audio__": {"b": F.lit(5)}}, payload="a", prepare=lambda x: x * 2)
    assert [(r.id, r.a, r.b) for r in made.orderBy("id").collect()] == [(1, "new", 10), (2, "y", 10), (3, None, 10)]
    with pytest.raises(ValueError):
        registry.apply_metadata(df, lambda c: {"__replace__": c["a"]})


def test_code_matrices(spark):
    df = spark.createDataFrame([([[1, 2, 3], [4, 5, 6]],), ([[1, 4], [2, 5], [3, 6]],), (None,), ([[7]],)], "c array<array<int>>")
    got = [r.m for r in df.select(ar.code_matrix("c").alias("m")).collect()]
    assert got == [[[1, 2, 3], [4, 5, 6]], [[1, 2, 3], [4, 5, 6]], None, [[7]]]


def test_vectors_of_different_lengths():
    from tonearm.operators.attribution import rows_of

    column = pa.array([[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]])
    assert rows_of(column, 2).tolist() == [[1.0, 2.0], [4.0, 5.0]] and rows_of(column.slice(1)).tolist() == [[4.0, 5.0, 6.0]]
    with pytest.raises(ValueError):
        rows_of(pa.array([[1.0], [1.0, 2.0]]))


def test_grids_in_blocks(spark):
    from tonearm.operators.attribution import complete_grid
    from tonearm.operators.matching import leave_one_out

    rows, few = spark.createDataFrame([(i, i % 3) for i in range(20)], "x int, s int"), spark.createDataFrame([(i,) for i in range(11)], "m int")
    for block in (3, 100):
        got = complete_grid(rows, few, block)
        assert got.columns == ["x", "s", "m"] and sorted(tuple(r) for r in got.collect()) == sorted((x, x % 3, m) for x in range(20) for m in range(11))
    assert complete_grid(rows, few.limit(0)).count() == 0
    left = leave_one_out(rows, "s", spark.createDataFrame([(1,), (2,)], "n int"), "n").groupBy("model_id").count().collect()
    assert {r.model_id: r["count"] for r in left} == {0: 20, 1: 13, 2: 14}


def test_a_cache_without_its_label_is_made_anew(spark, tmp_path):
    import shutil

    where, calls = str(tmp_path / "c"), []

    def make():
        calls.append(1)
        return spark.range(4)

    for _ in range(2):
        assert registry.cached(spark, where, {"m": "1"}, make).count() == 4
    assert len(calls) == 1
    shutil.rmtree(tmp_path / "c" / "_made_of")
    assert registry.cached(spark, where, {"m": "1"}, make).count() == 4 and len(calls) == 2


def test_largest_scores_are_kept_in_the_scan(spark):
    from tonearm.operators.attribution import gather_products

    rng = np.random.default_rng(8)
    q, x = rng.normal(size=(5, 6)), rng.normal(size=(700, 6))
    asks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "id int, v array<double>")
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>").repartition(5)
    every = gather_products(asks, base, "id", "id", "v").collect()
    best = gather_products(asks, base, "id", "id", "v", most=7).collect()
    for i in range(5):
        want = sorted((r for r in every if r.query == i), key=lambda r: -r.score)[:7]
        assert {(r.train, round(r.score, 9)) for r in best if r.query == i} == {(r.train, round(r.score, 9)) for r in want}
