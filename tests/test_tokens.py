"""Token operators against plain statements of what they mean."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tonearm.operators import tokens as tk

SEP = (tk.SEPARATOR,) * 3


def _df(spark, seqs, name="e"):
    return spark.createDataFrame([(i, [tuple(map(int, t)) for t in s]) for i, s in enumerate(seqs)], f"id int, {name} {tk.TRIPLE}")


def _seq(rng, n, controls=False, rests=True):
    t, out = 0, []
    for _ in range(n):
        t += rng.choice([0, 0, 3, 40, 150, 420])
        up = tk.CONTROL if controls else 0
        if rests and not controls and rng.random() < 0.1:
            out.append((t, tk.DUR, tk.REST))
        else:
            out.append((t + up, tk.DUR + rng.randrange(900) + up, tk.NOTE + rng.randrange(tk.MAX_NOTE) + up))
    return out


SEQS = [[], [SEP], [(5, tk.DUR, tk.REST)]] + [_seq(random.Random(i), i % 23) for i in range(60)]


def _got(df, *cols):
    return [tuple([tuple(x) for x in c] if isinstance(c, list) else c for c in r) for r in df.orderBy("id").select(*cols).collect()]


def _plain_pad(seq, end, density):
    out, before = [], 0
    for e in [*seq, (end, None, None)]:
        k = before + density
        while k < e[0]:
            out.append((k, tk.DUR, tk.REST))
            k += density
        if e[1] is not None:
            out.append(e)
            before = e[0]
    return out


@pytest.mark.parametrize("density", [100, 37])
def test_pad_and_unpad(spark, density):
    seqs = [s for s in SEQS if SEP not in s]
    got = _got(_df(spark, seqs), tk.pad("e", density=density), tk.unpad(tk.pad("e")), tk.pad("e", 2000, density))
    for s, (p, u, q) in zip(seqs, got):
        assert p == _plain_pad(s, max([e[0] for e in s], default=0), density)
        assert u == [e for e in s if e[2] != tk.REST]
        assert q == _plain_pad(s, 2000, density)


def test_anticipate(spark):
    rows, want = [], []
    for i in range(80):
        rng = random.Random(100 + i)
        ev, co = _seq(rng, i % 9), _seq(rng, i % 5, controls=True)
        rows.append((i, ev, co))
        out, left, clock = [], list(co), 0
        for e in ev:
            while left and clock >= left[0][0] - tk.CONTROL - 50:
                out.append(left.pop(0))
            out.append(e)
            clock = e[0]
        want.append((out, left))
    df = spark.createDataFrame(rows, f"id int, e {tk.TRIPLE}, c {tk.TRIPLE}")
    assert _got(df, *tk.anticipate("e", "c", 50)) == want


def test_clip_mask_and_times(spark):
    seqs = SEQS + [[(300, tk.DUR + 10, tk.NOTE), (500, tk.DUR + 10, tk.NOTE), (501, tk.DUR, tk.NOTE)], [(7, tk.DUR, tk.NOTE), SEP, (2, tk.DUR, tk.NOTE)]]
    seqs = [s for s in seqs if s != [SEP]]
    got = _got(_df(spark, seqs), tk.clip("e", 300, 500), tk.mask("e", 3.0, 5.0), tk.min_time("e"), tk.max_time("e"), tk.sparsity("e"))
    for s, (c, m, lo, hi, gap) in zip(seqs, got):
        own = [e for e in s if e != SEP]
        if SEP not in s:
            assert c == [(t, d - max(0, t + d - tk.DUR - 500), n) for t, d, n in s if 300 <= t <= 500]
            assert m == [e for e in s if not 300 < e[0] < 500]
        assert lo == min([e[0] for e in (s[: s.index(SEP)] if SEP in s else s)], default=0)
        assert hi == max([e[0] for e in own], default=0)
        times = [0, *(e[0] for e in own)]
        assert gap == max([b - a for a, b in zip(times, times[1:])] + [0])


def test_translate_stops_at_a_separator(spark):
    s = [(5, tk.DUR, tk.NOTE), SEP, (9, tk.DUR, tk.NOTE)]
    assert _got(_df(spark, [s, []]), tk.translate("e", 3)) == [([(8, tk.DUR, tk.NOTE), SEP, (9, tk.DUR, tk.NOTE)],), ([],)]
    with pytest.raises(Exception, match="time under 0"):
        _df(spark, [s]).select(tk.translate("e", -6)).collect()


def test_compound_round_trip_and_separators(spark):
    a, b = (10, tk.DUR + 20, tk.NOTE + 128 * 3 + 60), (40, tk.DUR + 5, tk.NOTE + 7)
    got = _got(_df(spark, [[a, SEP, b, SEP, b], [SEP], []]), tk.events_to_compound("e"))
    assert got[0][0] == [(10, 20, 60, 3, 72), (40 + 30, 5, 7, 0, 72), (40 + 30 + 45, 5, 7, 0, 72)]
    assert got[1][0] == [] and got[2][0] == []
    seqs = [[e for e in s if e[2] != tk.REST and e != SEP] for s in SEQS]
    df = _df(spark, seqs).withColumn("c", tk.events_to_compound("e"))
    assert [r[0] for r in _got(df, tk.compound_to_events("c")[0])] == seqs
    words = spark.createDataFrame([(0, [(0, -1, 5, 1, 9), (1, 1000, 5, 1, 9), (2, 999, 5, 128, 9)])], "id int, c array<struct<time:int,dur:int,note:int,instr:int,velocity:int>>")
    (events, cut), *_ = _got(words, *tk.compound_to_events("c"))
    assert [e[1] - tk.DUR for e in events] == [25, 999, 999] and cut == 1


def test_pack_and_flat(spark):
    df = spark.createDataFrame([(0, [1, 2, 3, 4, 5, 6, 7]), (1, []), (2, None)], "id int, f array<int>")
    got = [r[0] for r in df.orderBy("id").select(tk.flat(tk.pack("f"))).collect()]
    assert got == [[1, 2, 3, 4, 5, 6], [], []]


def test_pair_notes_is_first_in_first_out(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for piece in range(20):
        open_, taken = {}, {}
        for i in range(60):
            note, on, t = rng.randrange(3), rng.random() < 0.5, i / 10
            rows.append((piece, i, t, on, 0, note, 0))
            if on:
                open_.setdefault(note, []).append(i)
                taken[i] = -1
            elif open_.get(note):
                k = open_[note].pop(0)
                taken[k] = round(100 * (t - k / 10))
        want.update({(piece, k): v for k, v in taken.items()})
    df = spark.createDataFrame(rows, "piece int, seq int, t double, on boolean, instr int, note int, channel int")
    got = {(r.piece, r.onset_order): r.dur_ticks for r in tk.pair_notes(df, "piece", "seq", "t", "on", ["instr", "note", "channel"]).collect()}
    assert got == want


def test_extraction_keeps_all_events(spark):
    seqs = [[e for e in _seq(random.Random(i), 40, rests=False)] for i in range(10)] + [[]]
    df = _df(spark, seqs)
    for e, c in (tk.extract_instruments("e", F.array(F.lit(3))), tk.extract_random("e", F.col("id"), 5.0, 1)):
        for s, (a, b) in zip(seqs, _got(df, e, c)):
            assert sorted(a + [tuple(x - tk.CONTROL for x in y) for y in b]) == sorted(s)
    got = {r.id: r for r in tk.extract_spans(df, "id", "e", 0.2, 3).collect()}
    for i, s in enumerate(seqs):
        raised = [tuple(x - tk.CONTROL for x in got[i].controls[k : k + 3]) for k in range(0, len(got[i].controls), 3)]
        plain = [tuple(got[i].events[k : k + 3]) for k in range(0, len(got[i].events), 3)]
        assert sorted(raised + plain) == sorted(s)
        if raised:
            first = raised[0][0]
            assert all(e in raised for e in s if first < e[0] < first + tk.DELTA)


def test_windows_of_a_piece(spark):
    rows = [(1, k, [(j * 10, tk.DUR, tk.NOTE + j) for j in range(30)]) for k in range(4)] + [(2, 0, [(0, tk.DUR, tk.NOTE)])]
    df = spark.createDataFrame(rows, f"id int, o int, e {tk.TRIPLE}")
    got = tk.windows_of_piece(df, "id", "o", "e", 50).orderBy("window_no").collect()
    assert [r.window_no for r in got] == [0, 1] and all(len(r.tokens) == 151 and r.tokens[0] == tk.AUTOREGRESS for r in got)
    assert got[0].tokens[1] == 0 and got[1].tokens[1] == 0
    times = got[0].tokens[1::3]
    assert times[29] == 290 and times[30] == 300
