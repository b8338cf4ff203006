from __future__ import annotations

import math
import os.path
import posixpath
from pathlib import PurePosixPath

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tonearm.functions import arrays as ar
from tonearm.functions import paths as pa
from tonearm.functions import scalar as sc
from tonearm.functions.ids import digits_number


def test_normpath_and_names(spark):
    given_paths = ["", ".", "/", "a", "a/b.tar.gz", "./a//b/../c", "../x", "../../x/..", "/..", "/a/../../b", "a/..", "a/../..", ".bashrc", "d.x/.hid", "a/./b/.", "x/", "né/ü.mp3"]
    df = spark.createDataFrame([(p,) for p in given_paths] + [(None,)], "p string")
    for r in df.select("p", pa.normpath("p").alias("n"), pa.stem("p").alias("s"), pa.abspath("p", "/cwd").alias("a")).collect():
        if r.p is None:
            assert r.n is None
            continue
        assert r.n == posixpath.normpath(r.p), r.p
        assert r.a == posixpath.normpath(posixpath.join("/cwd", r.p)), r.p
        assert r.s == os.path.splitext(r.p.rsplit("/", 1)[-1])[0], r.p


@settings(max_examples=20, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b.c", "..", ".", "", "x"]), min_size=1, max_size=7), min_size=20, max_size=40))
def test_normpath_property(spark, parts):
    ps = ["/".join(p) for p in parts]
    ps = [p for p in ps if not (p.startswith("//") and not p.startswith("///"))]
    got = spark.createDataFrame([(p,) for p in ps], "p string").select("p", pa.normpath("p").alias("n")).collect()
    assert all(r.n == posixpath.normpath(r.p) for r in got)


def test_candidate_keys(spark):
    df = spark.createDataFrame([("/r/a/b.mp3", "a/b.mp3"), ("x.wav", None), (None, None), ("", "")], "p string, r string")
    got = [r.k for r in df.select(pa.candidate_keys("p", "r").alias("k")).collect()]
    assert got[0] == ["/r/a/b.mp3", "b.mp3", "b", "a/b.mp3", "/a/b.mp3"]
    assert got[1] == ["x.wav", "/x.wav", "x"]
    assert got[2] == [] and got[3] == []
    assert PurePosixPath("/r/a/b.mp3").stem == "b"


def test_numbers_in_ids(spark):
    df = spark.createDataFrame([("artist_000042",), (" Artist 42 ",), ("x",), (None,), ("9" * 30,)], "s string")
    assert [r[0] for r in df.select(digits_number("s")).collect()] == [42, 42, None, None, None]
    df = spark.createDataFrame([("/dir9/x12y3.mp3",), ("none",), (None,)], "s string")
    assert [tuple(r) for r in df.select(sc.first_number_of_name("s"), sc.last_number_before_extension("s")).collect()] == [(12, 3), (None, None), (None, None)]


def test_tags(spark):
    df = spark.createDataFrame([(["genre---Hip_Hop", "bare  tag", "Mood---a---b", " ", "genre---"],)], "t array<string>")
    r = df.select(sc.tags_by_type("t").alias("m"), sc.tags_by_type("t", lower=True).alias("l"), sc.values_of_type("t", "genre").alias("g")).first()
    assert r.m == {"genre": ["Hip Hop"], "tag": ["bare tag"], "Mood": ["a---b"]}
    assert "mood" in r.l and r.g == ["Hip Hop"]


def test_snr_and_gain(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (0.0,), (-1.0,), (0.5,), (None,), (math.nan,), (math.inf,)], "i double")
    got = [r[0] for r in df.select(sc.snr_from_slope("i")).collect()]
    assert got == [math.inf, math.inf, 0.0, 0.0, 1.0, None, None, None]
    r = spark.createDataFrame([(-1.0, 2.0), (math.inf, 2.0), (1.0, 2.0), (1.0, None)], "s double, v double").select(sc.marginal_gain("s", "v", 1.0)).collect()
    assert [x[0] for x in r] == [None, 0.0, 0.25, None]


def test_prompts_are_seeded(spark):
    df = spark.createDataFrame([(i, "t", ["a", "b", "c"]) for i in range(300)] + [(999, None, [])], "k int, title string, tags array<string>")
    col = sc.random_prompt(F.col("k"), {"title": F.col("title")}, {"tag": F.col("tags")}, 5)
    a, b = [r[0] for r in df.select(col).collect()], [r[0] for r in df.select(col).collect()]
    assert a == b and a[-1] is None and all(a[:-1]) and len(set(a)) > 10
    assert any("tags: " in x for x in a[:-1]) and any(":" not in x for x in a[:-1])


def test_timesteps_and_tokens(spark):
    df = spark.createDataFrame([(0, 10), (3, 10), (20, 10), (5, 0)], "k int, n int")
    got = [tuple(r) for r in df.select(sc.picked_timesteps("k", "n"), sc.picked_timesteps("k", "n", uniform=False)).collect()]
    assert got == [([], []), ([0, 3, 6], [0, 1, 2]), (list(range(10)), list(range(20))), ([], list(range(5)))]
    texts = spark.createDataFrame([("a  b\nc",), ("",), (" ",), (None,)], "s string")
    assert [r[0] for r in texts.select(sc.token_count("s")).collect()] == [3, 0, 0, None]


def test_vectors(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(2, 20, 8))
    df = spark.createDataFrame([(x[i].tolist(), y[i].tolist()) for i in range(20)] + [([0.0] * 8, y[0].tolist())], "x array<double>, y array<double>")
    r = df.select(ar.cosine("x", "y").alias("c"), ar.norm(ar.unit("x")).alias("n"), ar.distortion_ratio("x", "y").alias("s"), ar.log_sum_exp("x").alias("l")).collect()
    for i in range(20):
        assert abs(r[i].c - x[i] @ y[i] / np.linalg.norm(x[i]) / np.linalg.norm(y[i])) < 1e-12
        assert abs(r[i].n - 1) < 1e-12
        a, b = x[i] - x[i].mean(), y[i] - y[i].mean()
        f = b * (a @ b / (b @ b + 1e-8))
        assert abs(r[i].s + 10 * np.log10(f @ f / ((a - f) @ (a - f) + 1e-8) + 1e-8)) < 1e-9
        assert abs(r[i].l - np.log(np.exp(x[i]).sum())) < 1e-12
    assert r[20].c == 0 and r[20].n == 0


def test_signals(spark):
    df = spark.createDataFrame([([],), ([0.0, 0.0],), ([0.5, -1.0, 0.0, 0.25, 0.1],)], "v array<double>")
    r = df.select(ar.peak_db("v").alias("p"), ar.pad_crop("v", 3).alias("c"), ar.pad_mask("v", 3).alias("m"), ar.centred_clip("v", 3).alias("k"), ar.fold_patches("v", 2).alias("f")).collect()
    assert [x.p for x in r[1:]] == [-math.inf, 0.0]
    assert [x.c for x in r] == [[0.0] * 3, [0.0] * 3, [0.5, -1.0, 0.0]]
    assert [x.m for x in r] == [[0, 0, 0], [1, 1, 0], [1, 1, 1]]
    assert r[2].k == [-1.0, 0.0, 0.25] and r[2].f == [[0.5, 0.0, 0.1], [-1.0, 0.25, 0.0]] and r[0].f == [[], []]


def test_soft_mask(spark):
    got = spark.range(1).select(ar.soft_mask(20, 20, 80, 10, 20, 0.5)).first()[0]
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(8) / 7)
    want = np.zeros(20)
    want[4:16] = 1
    want[4:6] = (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(4) / 3))[:2]
    want[12:16] = hann[4:]
    assert np.allclose(got, want * 0.5)
