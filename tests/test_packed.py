from __future__ import annotations

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from tonearm.operators import packed as pk
from tonearm.operators.packed import Cover, learn_values, split_packed

KNOWN = ["genre---rock", "genre---hip hop", "genre---60s, 70s & 80s", "mood/theme---calm | quiet", "live", 'instrument---7" vinyl', "genre---rock 'n' roll", "genre---afro---cuban"]
COVER = Cover({v: -3.0 - i / 10 for i, v in enumerate(KNOWN)})


def test_delimiters():
    for sep in ("\t", ",", ", ", ";", "; ", "|", " | ", " / "):
        assert COVER.split(sep.join(["genre---rock", "live", "genre---hip hop"])) == ["genre---rock", "live", "genre---hip hop"]
    assert COVER.split("genre---rock live") == ["genre---rock", "live"]
    assert COVER.split("genre---hip hop live") == ["genre---hip hop", "live"]


def test_protected_values():
    assert COVER.split("genre---60s, 70s & 80s, live") == ["genre---60s, 70s & 80s", "live"]
    assert COVER.split("live|mood/theme---calm | quiet|live") == ["live", "mood/theme---calm | quiet", "live"]
    assert COVER.split('"unknown, value"; live') == ["unknown, value", "live"]


def test_quotes_and_lists():
    assert COVER.split("['genre---rock', \"genre---rock 'n' roll\"]") == ["genre---rock", "genre---rock 'n' roll"]
    assert COVER.split('["live", "a \\"b\\" c"]') == ["live", 'a "b" c']
    assert COVER.split('"instrument---7"" vinyl"\t"live"') == ['instrument---7" vinyl', "live"]
    assert COVER.split('instrument---7" vinyl,live') == ['instrument---7" vinyl', "live"]


def test_marks_inside_values_quote_nothing():
    field = "genre---rock 'n' roll; live; genre---hip hop;genre---rock | 'mood/theme---calm | quiet'"
    assert COVER.split(field) == ["genre---rock 'n' roll", "live", "genre---hip hop", "genre---rock", "mood/theme---calm | quiet"]


def test_nothing():
    for s in ("", "  ", ",;|", "[]", '""', "\t\t", " / "):
        assert COVER.split(s) == []


def test_unknown_pieces_and_long_fields():
    assert COVER.split("new one, live") == ["new one", "live"]
    assert Cover({}).split("a b,c") == ["a b", "c"]
    long = ",".join(["genre---rock"] * 50_000)
    assert COVER.split(long) == ["genre---rock"] * 50_000
    assert COVER.split("x" * 100_000) == ["x" * 100_000]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(KNOWN), min_size=1, max_size=8), st.sampled_from(["json", "csv", "tab"]))
def test_round_trip(tags, form):
    packed = json.dumps(tags) if form == "json" else ",".join('"' + t.replace('"', '""') + '"' for t in tags) if form == "csv" else "\t".join(tags)
    assert COVER.split(packed) == tags


def test_operator(spark):
    rows = [(1, "a---x,b---y,a---x", 7), (2, None, 8), (3, "", 9), (4, 'b---y, "p, q"', 1), (4, 'b---y, "p, q"', 1), (5, "a---x b---y", 2)] + [(i, "a---x\tb---y", 0) for i in range(10, 20)]
    df = spark.createDataFrame(rows, "id int, tags string, position int")
    got = split_packed(df, "tags")
    assert got.columns == ["id", "tags", "position", "value"]
    by = {}
    for r in got.collect():
        by.setdefault(r.id, []).append((r.position, r.value))
    assert sorted(by[1]) == [(1, "a---x"), (2, "b---y"), (3, "a---x")]
    assert 2 not in by and 3 not in by
    assert sorted(by[4]) == [(1, "b---y"), (1, "b---y"), (2, "p, q"), (2, "p, q")]
    assert sorted(by[5]) == [(1, "a---x"), (2, "b---y")]


def test_empty_table(spark):
    df = spark.createDataFrame([], "id int, tags string")
    assert learn_values(df, "tags") == {}
    assert split_packed(df, "tags").count() == 0


def test_blank_delimited_fields_are_no_values(spark):
    df = spark.createDataFrame([("a---x b---y",)] * 4 + [("a---x",)] * 5 + [("b---y",)] * 5, "tags string")
    assert set(learn_values(df, "tags")) == {"a---x", "b---y"}


def test_unknown_values_of_any_number_of_words():
    known = {"Rock": -1.0, "Jazz": -1.0, "genre---a long known value": -1.0}
    words = " ".join(f"w{i}xyz" for i in range(40))
    c = Cover(known)
    assert c.cover(f"{words} Rock") == [words, "Rock"]
    assert c.cover(f"{words}  genre---a long known value {words}, Jazz") == [words, "genre---a long known value", words, "Jazz"]
    assert len(c.cover(" ".join(f"w{i}xyz" for i in range(20_000)))) == 1


def test_long_values_are_known(spark):
    long = "many words of one value, " * 20 + "end"
    rows = [(f'"{long}"',)] * 5 + [(f"{long}; x",)]
    df = spark.createDataFrame(rows, "s string")
    known = learn_values(df, "s")
    assert long in known and Cover(known).split(f"{long}; x") == [long, "x"]


def test_composites_of_long_parts(spark):
    long = "p q r s t u v w"
    rows = [(long,)] * 6 + [("Rock",)] * 6 + [(f"{long} Rock",)] * 4
    known = learn_values(spark.createDataFrame(rows, "s string"), "s")
    assert set(known) == {long, "Rock"}


def test_a_dictionary_too_large_to_send(spark, sf, monkeypatch):
    random = __import__("random").Random(4)
    seps = [", ", ";", " | ", " ", "\t", " / "]
    rows = [(i, random.choice(seps).join(random.choice([*KNOWN, "rare one", "p q", "p", "q", f"x{i % 7}"]) for _ in range(random.randint(1, 6)))) for i in range(400)]
    rows += [(i, json.dumps([random.choice(KNOWN) for _ in range(3)])) for i in range(400, 500)] + [(500, None), (501, ""), (502, "a / b ]c")]
    for df, column in ((spark.createDataFrame(rows, "id int, tags string"), "tags"), (spark.read.parquet(f"{sf}/autotagging.parquet").select("line_no", "tags"), "tags")):
        one = df.columns[0]
        want = sorted(map(str, split_packed(df, column).select(one, "position", "value").collect()))
        with monkeypatch.context() as m:
            m.setattr(pk, "SENT_VALUES", 3)
            known = learn_values(df, column)
            got = sorted(map(str, split_packed(df, column, known).select(one, "position", "value").collect()))
        assert not isinstance(known, dict) and {r.value for r in known.collect()} == set(learn_values(df, column))
        assert got == want


def test_stretches_hold_what_a_cover_asks_for():
    fields = ["a b,c", "['x y', \"z\"]", "p / q/r ] s", ";;a  b", '"q ""r"" s" t', "", "'"]
    for f in fields:
        asked = pk._stretches(f, 100)
        for part in Cover({}).split(f):
            assert part in asked, (f, part, asked)


def test_the_dictionary_counts_uses_and_rows(spark, sf):
    from tonearm.plans import core_registry

    rows = spark.read.parquet(f"{sf}/autotagging.parquet").select("line_no", "tags")
    want = {}
    for r in split_packed(rows, "tags").collect():
        uses, lines, last = want.setdefault(r.value, [0, set(), 0])
        lines.add(r.line_no)
        want[r.value] = [uses + 1, lines, max(last, r.position)]
    got = {r.tag: (r.n_uses, r.n_rows, r.last_pos) for r in core_registry().queries["p1_dictionary"](spark, sf).collect()}
    assert got == {t: (u, len(x), p) for t, (u, x, p) in want.items()}
