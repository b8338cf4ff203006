from __future__ import annotations

import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from tonearm.sources import files, registry, sinks, text


@pytest.fixture()
def tree(tmp_path):
    for p in ("a/1.MP3", "a/b/2.wav", "a/.hid.mp3", "a/song_x.mp3", "c/note.txt", "x__MACOSX/song_y.mp3"):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"x" * len(p))
    return tmp_path


def test_scan(spark, tree):
    name = lambda df: sorted(r.path[len(str(tree)) + 1 :] for r in df.collect())
    assert name(files.scan(spark, str(tree), [".mp3", ".wav"])) == ["a/1.MP3", "a/b/2.wav", "a/song_x.mp3", "x__MACOSX/song_y.mp3"]
    assert name(files.scan(spark, str(tree), [".mp3"], ["SONG"])) == ["a/song_x.mp3", "x__MACOSX/song_y.mp3"]
    assert files.scan(spark, str(tree / "none"), [".mp3"]).count() == 0
    assert files.scan_roots(spark, [str(tree / "a"), str(tree)], [".wav"]).count() == 2
    d = files.discover(spark, [str(tree / "a")], [".wav"]).first()
    assert d.relpath == "b/2.wav"
    big = files.largest_first(spark, str(tree / "a"), [".mp3", ".wav"], 2, 7).orderBy("idx").collect()
    assert [r.idx for r in big] == [0, 1] and [r.too_large for r in big] == [False, True]


def test_extensions():
    assert files.parse_extensions(" WAV,.mp3,,wav") == [".wav", ".mp3"]
    with pytest.raises(ValueError):
        files.parse_extensions(" , ")


def test_latents_and_config(spark, tree):
    assert files.latents(spark, str(tree / "a"), [".wav"]).count() == 1
    (tree / "a/filelist.txt").write_text("x.npy\ny.npy\n")
    assert sorted(r.path[-6:] for r in files.latents(spark, str(tree / "a"), [".wav"]).collect()) == ["/x.npy", "/y.npy"]
    (tree / "c.json").write_text(json.dumps({"dataset_type": "audio_dir", "datasets": [{"id": "i", "path": str(tree / "a")}]}))
    assert files.roots_of_config(spark, str(tree / "c.json")) == [str(tree / "a")]
    (tree / "d.json").write_text(json.dumps({"dataset_type": "s3", "datasets": []}))
    with pytest.raises(ValueError):
        files.roots_of_config(spark, str(tree / "d.json"))


def test_names_with_underscores_and_banned_names(spark, tree):
    name = lambda df: sorted(r.path[len(str(tree)) + 1 :] for r in df.collect())
    (tree / "a" / "__MACOSX_song.mp3").write_bytes(b"1")
    (tree / "a" / "_song.mp3").write_bytes(b"1")
    assert name(files.scan(spark, str(tree), ["mp3"], ["SONG"])) == ["a/_song.mp3", "a/song_x.mp3", "x__MACOSX/song_y.mp3"]


def test_tar_members(spark, tmp_path):
    with tarfile.open(tmp_path / "s.tar", "w") as t:
        for n, b in (("k1.json", b"{}"), ("k1.wav", b"abc"), ("d/k2.wav", b"z"), ("../evil.wav", b"!")):
            info = tarfile.TarInfo(n)
            info.size = len(b)
            t.addfile(info, io.BytesIO(b))
    got = {r.key: dict(r.fields) for r in files.members(spark, str(tmp_path / "s.tar")).collect()}
    assert got == {"k1": {"json": bytearray(b"{}"), "wav": bytearray(b"abc")}, "d/k2": {"wav": bytearray(b"z")}}


def test_lines_keep_their_numbers(spark, tmp_path):
    (tmp_path / "t.txt").write_text("".join(f"line {i}\n" for i in range(500)))
    got = text.numbered_lines(spark, str(tmp_path / "t.txt")).orderBy("line_no").collect()
    assert [r.value for r in got] == [f"line {i}" for i in range(500)] and [r.line_no for r in got] == list(range(500))


def test_ragged_catalog(spark):
    rows = ["TRACK_ID\tARTIST_ID\tALBUM_ID\tPATH\tDURATION\tTAGS", "t_07\ta\tb\tp.mp3\t1.5\tgenre---X_y\tmood/theme---m\r", "t\ta\tb\tp\tbad", "short\tx", ""]
    got = text.with_tag_lists(text.ragged_catalog(spark.createDataFrame([(r,) for r in rows], "value string"))).collect()
    assert len(got) == 2
    assert (got[0].genres, got[0].moods, got[0].track_num, got[0].duration) == (["X y"], ["m"], 7, 1.5)
    assert (got[1].genres, got[1].duration, got[1].tags) == ([], None, [])


def test_metadata_last_line_wins(spark):
    rows = [(0, "TRACK_ID\tTRACK_NAME\tRELEASEDATE"), (1, "t\told\t1999-01-01"), (2, "t\tnew\t2001-05-05"), (3, "short"), (4, "u\tn\t")]
    meta = text.metadata(spark.createDataFrame(rows, "line_no int, value string"), ["TRACK_ID", "TRACK_NAME", "RELEASEDATE"])
    got = {r.track_id: r for r in meta.collect()}
    assert (got["t"].track_name, got["t"].year, got["u"].year) == ("new", "2001", "")


def test_integers_and_queries(spark):
    ok = spark.createDataFrame([("1, 2,,",), ("",), ("-3",)], "value string")
    assert sorted(r.value for r in text.integers(ok).collect()) == [-3, 1, 2]
    with pytest.raises(Exception, match="CAST_INVALID"):
        text.integers(spark.createDataFrame([("1,x",)], "value string")).collect()
    lines = spark.createDataFrame([(0, "a b"), (1, " "), (2, "c")], "line_no int, value string")
    assert [(r.prompt_id, r.num_tokens) for r in text.first_queries(lines, 3).orderBy("query_index").collect()] == [("query_0000", 2), ("query_0002", 1)]


def test_registry(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "p"))
    assert registry.load(spark, {"dataset_type": "parquet", "datasets": [{"path": str(tmp_path / "p")}]}).count() == 3
    with pytest.raises(ValueError):
        registry.load(spark, {"dataset_type": "nothing"})
    calls = []
    make = lambda: (calls.append(1), spark.range(4))[1]
    where = str(tmp_path / "cache")
    for made, n in (({"m": "1"}, 1), ({"m": "1"}, 1), ({"m": "2"}, 2)):
        assert registry.cached(spark, where, made, make).count() == 4 and len(calls) == n
    assert registry.first_source(lambda: None, lambda: spark.range(1)).count() == 1
    with pytest.raises(ValueError):
        registry.first_source(lambda: None)
    spark.createDataFrame([(1, "q", 2.0)], "seller_id int, prompt_id string, a double").write.parquet(str(tmp_path / "m"))
    registry.method("one", "m", "a")
    assert tuple(registry.method_scores(spark, str(tmp_path), "one").first()) == ("1", "q", 2.0)


def test_user_functions(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "k int, s string")
    got = registry.apply_metadata(df, lambda c: {"s": F.upper(c["s"]), "__reject__": c["s"] == "b"}).collect()
    assert [tuple(r) for r in got] == [(1, "A"), (2, None)]
    conv = registry.converted(df, {"s": lambda c: F.concat(c, F.lit("!")), "t": lambda c: c}, {"t": "k"})
    assert [tuple(r) for r in conv.collect()][0] == (1, "a!", 1)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", None), (0, "y", 2.0)], "k int, s string, v double")
    sinks.write_csv(df, str(tmp_path / "c"), ["s", "k"])
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["s", "k"]
    sinks.write_jsonl(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    sinks.write_document(df, str(tmp_path / "d"))
    assert json.loads(spark.read.text(str(tmp_path / "d")).first().value) == {"k": 1, "s": "x", "v": None}
    sinks.write_lines(df, "s", str(tmp_path / "l"))
    assert [r.value for r in spark.read.text(str(tmp_path / "l")).collect()] == ["x", "y"]
    sinks.write_if_absent(df, str(tmp_path / "p"))
    sinks.write_if_absent(df.limit(0), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    sinks.write_per_model(df.withColumnRenamed("k", "model_id"), str(tmp_path / "m"))
    assert (tmp_path / "m" / "model_id=0").is_dir()
    sinks.write_matrix(spark.createDataFrame([(5, 1, 0.5), (2000, 1, 0.1)], "query int, train int, score double"), str(tmp_path / "x"))
    assert spark.read.parquet(str(tmp_path / "x")).where("query_block = 1").count() == 1
    paths = spark.createDataFrame([(1, "/a", "a"), (2, "/b", "b")], "id bigint, path string, relpath string")
    sinks.write_dedup(spark.createDataFrame([(2, 1, 0.99)], "drop bigint, keep bigint, similarity double"), paths, df.limit(0), str(tmp_path / "dd"))
    assert spark.read.text(str(tmp_path / "dd/exclude")).first().value == "/b"
    assert json.loads(spark.read.text(str(tmp_path / "dd/summary")).first().value)["n_pairs"] == 1


def test_cut_survives_and_is_dropped(spark):
    from tonearm import storage

    t = storage.cut(spark.range(5), "t")
    assert t.count() == 5 and storage.shared_dir(spark)
    storage.drop_cuts()
