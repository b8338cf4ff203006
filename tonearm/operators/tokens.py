"""Sequences of event triples (time, duration, note) as arrays of structs, and of compound events with five fields.

Columns stay in generated code; the few loops whose state depends on all earlier events run per piece over Arrow.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonearm.functions.arrays import let
from tonearm.functions.scalar import draw

# Fixed values of the token vocabulary: ticks a second, sizes of the blocks, and what follows from them.
TICKS, MAX_TIME, MAX_DUR, PITCHES, INSTRUMENTS = 100, 10_000, 1_000, 128, 129
MAX_NOTE = PITCHES * INSTRUMENTS
TIME, DUR, NOTE = 0, MAX_TIME, MAX_TIME + MAX_DUR
REST = NOTE + MAX_NOTE
CONTROL = REST + 1
SEPARATOR = CONTROL + NOTE + MAX_NOTE
AUTOREGRESS, ANTICIPATE = SEPARATOR + 1, SEPARATOR + 2
DELTA, DEFAULT_VELOCITY, WINDOW_EVENTS = 5 * TICKS, 72, 341
# Fixed values of the interarrival vocabulary.
MAX_STEP = 1_000
START, END = MAX_STEP, MAX_STEP + MAX_NOTE
STEP_SEPARATOR = END + MAX_NOTE

TRIPLE = "array<struct<time:int,dur:int,note:int>>"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def triple(time: Column, dur: Column, note: Column) -> Column:
    """One event."""
    return F.struct(time.cast("int").alias("time"), dur.cast("int").alias("dur"), note.cast("int").alias("note"))


def pack(tokens: Column | str, stride: int = 3, names: Sequence[str] = ("time", "dur", "note")) -> Column:
    """A flat array of ints as an array of structs; what doesn't fill a struct is dropped."""
    t = _c(tokens)
    n = F.floor(F.size(t) / F.lit(stride)).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(*(F.get(t, i * stride + k).cast("int").alias(name) for k, name in enumerate(names))))


def flat(events: Column | str) -> Column:
    """The flat array of an array of triples."""
    return F.flatten(F.transform(_c(events), lambda e: F.array(e["time"], e["dur"], e["note"])))


def is_control(e: Column) -> Column:
    """Whether an event is anticipated; a separator isn't decoded as either."""
    return e["note"] >= CONTROL


def shift_of(e: Column) -> Column:
    """What a control's tokens are raised by."""
    return F.when(is_control(e), CONTROL).otherwise(0)


def ticks(e: Column) -> Column:
    """The time in ticks without offsets."""
    return e["time"] - shift_of(e)


def instrument(e: Column) -> Column:
    """The instrument of an event or control."""
    return F.floor((e["note"] - shift_of(e) - NOTE) / F.lit(PITCHES)).cast("int")


def decode(events: Column | str) -> Column:
    """An array of (time, dur, instrument, pitch, control, kind), kind being note, rest or separator."""

    def one(e: Column) -> Column:
        off = shift_of(e)
        note = e["note"] - off - NOTE
        kind = F.when(e["note"] == SEPARATOR, "separator").when(e["note"] == REST, "rest").otherwise("note")
        played = kind == "note"
        instr = F.floor(note / F.lit(PITCHES)).cast("int")
        return F.struct(
            F.when(kind != "separator", e["time"] - off).alias("time"),
            F.when(kind != "separator", e["dur"] - off - DUR).alias("dur"),
            F.when(played, instr).alias("instrument"),
            F.when(played, note - instr * PITCHES).alias("pitch"),
            (played & is_control(e)).alias("control"),
            kind.alias("kind"),
        )

    return F.transform(_c(events), one)


def clip(events: Column | str, start: int, end: int, cut_duration: bool = True) -> Column:
    """Events with start <= time <= end in ticks; durations end at end if they are cut."""
    kept = F.filter(_c(events), lambda e: (ticks(e) >= start) & (ticks(e) <= end))
    if not cut_duration:
        return kept
    over = lambda e: F.greatest(ticks(e) + e["dur"] - shift_of(e) - DUR - end, F.lit(0))
    return F.transform(kept, lambda e: triple(e["time"], e["dur"] - over(e), e["note"]))


def mask(events: Column | str, start: float, end: float) -> Column:
    """Events without those strictly between start and end, in seconds."""
    second = lambda e: ticks(e) / float(TICKS)
    return F.filter(_c(events), lambda e: ~((second(e) > start) & (second(e) < end)))


def delete(events: Column | str, criterion) -> Column:
    """Events for which the criterion (a function of the struct) isn't true."""
    return F.filter(_c(events), lambda e: ~F.coalesce(criterion(e), F.lit(False)))


def ordered(events: Column | str) -> Column:
    """Events by time; those of one time keep their order."""
    numbered = F.transform(_c(events), lambda e, i: F.struct(e["time"].alias("t"), i.alias("i"), e.alias("e")))
    return F.transform(F.array_sort(numbered), lambda s: s["e"])


def split(events: Column | str) -> tuple[Column, Column]:
    """(events, controls)."""
    return F.filter(_c(events), lambda e: ~is_control(e)), F.filter(_c(events), is_control)


def unpad(events: Column | str) -> Column:
    """Events without rests."""
    return F.filter(_c(events), lambda e: e["note"] != REST)


def pad(events: Column | str, end_time: Column | int | None = None, density: int = TICKS) -> Column:
    """Events with rests, so that no gap, from 0 on and up to the end, is longer than density. Events must be in order."""
    ev = _c(events)
    end = F.coalesce(_truthy(end_time), max_time(ev))

    def rests(before: Column, until: Column) -> Column:
        some = F.sequence(before + density, F.greatest(until - 1, before + density), F.lit(density))
        return F.when(until > before + density, F.transform(some, lambda t: triple(t, F.lit(DUR), F.lit(REST)))).otherwise(F.array().cast(TRIPLE))

    before = F.concat(F.array(F.lit(TIME)), F.transform(ev, lambda e: e["time"]))
    with_rests = F.zip_with(ev, F.slice(before, F.lit(1), F.size(ev)), lambda e, t: F.concat(rests(t, e["time"]), F.array(triple(e["time"], e["dur"], e["note"]))))
    return F.concat(F.flatten(with_rests), rests(F.element_at(before, -1), end))


def _truthy(v: Column | int | None) -> Column:
    c = v if isinstance(v, Column) else F.lit(v).cast("int")
    return F.when(c != 0, c)


def anticipate(events: Column | str, controls: Column | str, delta: int = DELTA) -> tuple[Column, Column]:
    """(tokens, controls left over): each control stands before the first event by whose predecessor's time (0 for the first)
    it is at most delta ahead, and no earlier than the control before it. Controls due only after the last event are left.
    Null if either is null.
    """
    names = ("time", "dur", "note")
    kind = pa.struct([(n, pa.int32()) for n in names])

    def fields(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The flat fields of a column of lists, and where each list ends."""
        inner = lists.flatten()
        flat_ = np.stack([inner.field(n).to_numpy(zero_copy_only=False) for n in names], axis=1) if len(inner) else np.empty((0, 3), np.int64)
        return flat_, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))

    def lists(rows: list[np.ndarray]) -> pa.Array:
        flat_ = np.concatenate([np.empty((0, 3), np.int32), *rows]).astype(np.int32)
        ends = np.cumsum([0, *(len(r) for r in rows)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(flat_[:, i]) for i in range(3)], fields=list(kind)))

    @F.arrow_udf(f"struct<tokens:{TRIPLE},left:{TRIPLE}>")
    def woven(events_: pa.Array, controls_: pa.Array) -> pa.Array:
        (e, e_ends), (c, c_ends) = fields(events_), fields(controls_)
        tokens, left = [], []
        for i in range(len(events_)):
            ev = e[e_ends[i - 1] if i else 0 : e_ends[i]]
            co = c[c_ends[i - 1] if i else 0 : c_ends[i]]
            clock = np.maximum.accumulate(np.concatenate([[0], ev[:-1, 0] - TIME])) if len(ev) else np.empty(0, np.int64)
            slot = np.maximum.accumulate(np.searchsorted(clock, co[:, 0] - CONTROL - delta, "left")) if len(co) else np.empty(0, np.int64)
            due = slot < len(ev)
            at = np.concatenate([slot[due] * 2, np.arange(len(ev)) * 2 + 1])
            tokens.append(np.concatenate([co[due], ev])[np.argsort(at, kind="stable")])
            left.append(co[~due])
        null = pc.or_(pc.is_null(events_), pc.is_null(controls_))
        list_of = pa.list_(kind)
        return pa.StructArray.from_arrays([lists(tokens), lists(left)], fields=[pa.field("tokens", list_of), pa.field("left", list_of)], mask=null)

    made = woven(_c(events), _c(controls))
    return made["tokens"], made["left"]


def sparsity(events: Column | str) -> Column:
    """The longest gap between neighbours, from 0 on; separators aside."""
    times = F.concat(F.array(F.lit(TIME)), F.transform(F.filter(_c(events), lambda e: e["note"] != SEPARATOR), lambda e: e["time"]))
    gaps = F.zip_with(F.slice(times, F.lit(2), F.size(times)), F.slice(times, F.lit(1), F.size(times) - 1), lambda b, a: b - a)
    return F.greatest(F.array_max(gaps), F.lit(0))


def before_separator(events: Column | str) -> Column:
    """The events before the first separator."""
    at = F.array_position(F.transform(_c(events), lambda e: e["note"] == SEPARATOR), True).cast("int")
    return F.when(at > 0, F.slice(_c(events), F.lit(1), F.greatest(at - 1, F.lit(0)))).otherwise(_c(events))


def _times(events: Column, instr: int | None) -> Column:
    some = events if instr is None else F.filter(events, lambda e: instrument(e) == instr)
    return F.transform(some, ticks)


def min_time(events: Column | str, instr: int | None = None) -> Column:
    """The least time in ticks before the first separator, of one instrument if asked; 0 for none."""
    return F.coalesce(F.array_min(_times(before_separator(events), instr)), F.lit(0))


def max_time(events: Column | str, instr: int | None = None) -> Column:
    """The largest time in ticks, separators skipped, at least 0."""
    some = F.filter(_c(events), lambda e: e["note"] != SEPARATOR)
    return F.greatest(F.coalesce(F.array_max(_times(some, instr)), F.lit(0)), F.lit(0))


def translate(events: Column | str, dt: Column | int) -> Column:
    """Times moved by dt up to the first separator; an error if one would fall under 0."""
    by = F.lit(dt) if isinstance(dt, int) else dt
    n = F.size(before_separator(events))
    moved = lambda e: F.when(ticks(e) + by >= 0, e["time"] + by).otherwise(F.raise_error(F.lit("a time under 0")).cast("int"))
    return let(n, lambda k: F.transform(_c(events), lambda e, i: F.when(i < k, triple(moved(e), e["dur"], e["note"])).otherwise(triple(e["time"], e["dur"], e["note"]))))


def combine(events: Column | str, controls: Column | str) -> Column:
    """Events and controls as events, by time."""
    plain = F.transform(_c(controls), lambda e: triple(e["time"] - CONTROL, e["dur"] - CONTROL, e["note"] - CONTROL))
    return ordered(F.concat(_c(events), plain))


def instrument_counts(events: Column | str) -> Column:
    """A map from instrument to its number of events and controls; separators aside, rests under the instrument they decode to."""
    own = F.transform(F.filter(_c(events), lambda e: e["note"] < SEPARATOR), instrument)
    counted = lambda held: F.map_from_arrays(F.array_distinct(held), F.transform(F.array_distinct(held), lambda k: F.size(F.filter(held, lambda x: x == k))))
    return let(own, counted)


def compound_to_events(compound: Column | str) -> tuple[Column, Column]:
    """(events, truncated) of compound events (time, dur, note, instr, velocity): unknown durations (-1) take a quarter second,
    those of ten seconds and more end just under and are counted.
    """

    def one(c: Column) -> Column:
        dur = F.when(c["dur"] == -1, TICKS // 4).otherwise(F.least(c["dur"], F.lit(MAX_DUR - 1)))
        return triple(c["time"] + TIME, dur + DUR, NOTE + F.when(c["note"] == -1, SEPARATOR).otherwise(PITCHES * c["instr"] + c["note"]))

    long = F.size(F.filter(_c(compound), lambda c: c["dur"] >= MAX_DUR))
    return F.transform(_c(compound), one), long


def events_to_compound(events: Column | str) -> Column:
    """Compound events of events and controls: rests and separators are dropped, each piece begins where the one before it
    ends, and the velocity is the default.
    """
    plain = F.transform(
        unpad(events),
        lambda e: F.when(e["note"] == SEPARATOR, triple(F.lit(-1), F.lit(-1), F.lit(-1))).otherwise(
            triple(e["time"] - shift_of(e), e["dur"] - shift_of(e) - DUR, e["note"] - shift_of(e) - NOTE)
        ),
    )
    # Of each piece between separators the largest end; the pieces before give the offset. What is folded is a number a piece.
    def words(held: Column) -> Column:
        stops = F.concat(F.filter(F.transform(held, lambda e, i: F.when(e["note"] == -1, i)), lambda i: i.isNotNull()), F.array(F.size(held)))
        starts = F.concat(F.array(F.lit(0)), F.transform(F.slice(stops, F.lit(1), F.size(stops) - 1), lambda i: i + 1))
        parts = F.zip_with(starts, stops, lambda a, b: F.slice(held, a + 1, b - a))
        most = F.transform(parts, lambda p: F.greatest(F.coalesce(F.array_max(F.transform(p, lambda e: e["time"] + e["dur"])), F.lit(0)), F.lit(0)))

        def put(tops: Column) -> Column:
            offset = lambda i: F.aggregate(F.slice(tops, F.lit(1), i), F.lit(0), lambda s, x: s + x)
            return F.flatten(F.transform(parts, lambda p, i: let(offset(i), lambda by: F.transform(p, lambda e: word(e, by)))))

        return let(most, put)

    def word(e: Column, by: Column) -> Column:
        instr = F.floor(e["note"] / F.lit(PITCHES)).cast("int")
        return F.struct(
            (e["time"] + by).cast("int").alias("time"),
            e["dur"].alias("dur"),
            (e["note"] - instr * PITCHES).cast("int").alias("note"),
            instr.alias("instr"),
            F.lit(DEFAULT_VELOCITY).alias("velocity"),
        )

    return let(plain, words)


def gate(compound: Column | str, least_events: int = 10, least_seconds: int = 1, most_seconds: int = 3600, most_instruments: int = 16) -> Column:
    """0 for a usable track, 1 for a short, 2 for a long one, 3 for too many instruments."""
    events, _ = compound_to_events(compound)
    end = max_time(events)
    return (
        F.when(F.size(_c(compound)) < least_events, 1)
        .when(end < TICKS * least_seconds, 1)
        .when(end > TICKS * most_seconds, 2)
        .when(F.size(F.map_keys(instrument_counts(events))) > most_instruments, 3)
        .otherwise(0)
    )


def extract_instruments(events: Column | str, chosen: Column) -> tuple[Column, Column]:
    """(events, controls): events of the chosen instruments become controls."""
    own = lambda e: F.array_contains(chosen, instrument(e))
    raised = F.transform(F.filter(_c(events), own), lambda e: triple(e["time"] + CONTROL, e["dur"] + CONTROL, e["note"] + CONTROL))
    return F.filter(_c(events), lambda e: ~own(e)), raised


def extract_random(events: Column | str, key: Column, rate: float, seed: int = 0) -> tuple[Column, Column]:
    """(events, controls): each event becomes a control with probability rate / 10, by keyed draws."""
    marked = F.transform(_c(events), lambda e, i: F.struct(e.alias("e"), (draw(seed, key, i) < rate / 10).alias("m")))
    plain = F.transform(F.filter(marked, lambda s: ~s["m"]), lambda s: s["e"])
    raised = F.transform(F.filter(marked, lambda s: s["m"]), lambda s: triple(s["e"]["time"] + CONTROL, s["e"]["dur"] + CONTROL, s["e"]["note"] + CONTROL))
    return plain, raised


def extract_spans(df: DataFrame, key: str, events: str, rate: float = 0.05, seed: int = 0) -> DataFrame:
    """(key, events, controls) as flat arrays: after exponential waits, spans of five seconds become controls; draws are keyed."""
    import hashlib

    def run(batches):
        for pdf in batches:
            out = []
            for k, flat_events in zip(pdf["k"], pdf["e"]):
                e = np.asarray(flat_events, np.int64).reshape(-1, 3)
                raised, at, no = np.zeros(len(e), bool), 0, 0
                while at < len(e):  # from one span's end to the next one's, by search in the sorted times
                    u = int(hashlib.md5(f"{seed}|{k}|{no}".encode()).hexdigest()[:10], 16) / float(1 << 40)
                    first = np.searchsorted(e[at:, 0], e[at, 0] + math.floor(-TICKS * math.log(1 - u) / rate)) + at
                    at = np.searchsorted(e[first:, 0], e[first, 0] + DELTA) + first if first < len(e) else len(e)
                    raised[first:at] = True
                    no += 1
                out.append((k, e[~raised].ravel().tolist(), (e[raised] + CONTROL).ravel().tolist()))
            yield pd.DataFrame(out, columns=["k", "events", "controls"])

    rows = df.select(F.col(key).alias("k"), flat(events).alias("e"))
    kind = dict(rows.dtypes)["k"]
    return rows.mapInPandas(run, f"k {kind}, events array<int>, controls array<int>").withColumnRenamed("k", key)


def pair_notes(messages: DataFrame, piece: str, order: str, time: str, on: str, note: Sequence[str]) -> DataFrame:
    """(piece, note..., onset_order, onset, dur_ticks): each note-on with the first later note-off of its (instrument, note,
    channel) that no earlier note-on took; -1 where none is left. Note-offs that nothing is open for are ignored.

    A note-off takes effect only if it isn't in excess, which running counts of the piece's note tell: with the balance of
    ons and offs and its least value so far, the effective offs are numbered as the ons are, and joined by number.
    """
    keys = [piece, *note]
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = messages.select(*keys, order, time, F.col(on).cast("boolean").alias("__on"))
    rows = rows.withColumn("__bal", F.sum(F.when(F.col("__on"), 1).otherwise(-1)).over(w))
    rows = rows.withColumn("__low", F.least(F.min("__bal").over(w), F.lit(0)))
    rows = rows.withColumn("__was", F.coalesce(F.lag("__low").over(Window.partitionBy(*keys).orderBy(order)), F.lit(0)))
    rows = rows.withColumn("__ok", F.col("__on") | (F.col("__low") == F.col("__was")))
    nth = F.row_number().over(Window.partitionBy(*keys, "__on").orderBy(order))
    used = rows.where("__ok").withColumn("__k", nth)
    ons = used.where("__on").select(*keys, "__k", F.col(order).alias("onset_order"), F.col(time).alias("onset"))
    offs = used.where("not __on").select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__k").alias("__j"), F.col(time).alias("__end"))
    same = F.col("__k") == F.col("__j")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    dur = F.coalesce(F.bround(TICKS * (F.col("__end") - F.col("onset"))).cast("int"), F.lit(-1))
    return ons.join(offs, same, "left").select(*keys, "onset_order", "onset", dur.alias("dur_ticks"))


def to_steps(messages: DataFrame, piece: str, order: str, time: str, on: str, instr: str, note: str) -> DataFrame:
    """(piece, order, part, token) of the interarrival encoding: before each message a step of the ticks since the message
    before it, if any, capped; then its start or end token. part tells the two apart.
    """
    w = Window.partitionBy(piece).orderBy(order)
    step = F.bround(TICKS * (F.col(time) - F.lag(time, 1, 0.0).over(w))).cast("int")
    rows = messages.withColumn("__s", F.least(step, F.lit(MAX_STEP - 1)))
    token = F.when(F.col(on).cast("boolean"), START).otherwise(END) + PITCHES * F.col(instr) + F.col(note)
    parts = F.array(F.struct(F.lit(0).alias("part"), F.col("__s").alias("token")), F.struct(F.lit(1).alias("part"), token.cast("int").alias("token")))
    return rows.select(piece, order, F.explode(F.filter(parts, lambda p: (p["part"] == 1) | (p["token"] > 0))).alias("p")).select(piece, order, "p.part", "p.token")


def from_steps(tokens: DataFrame, piece: str, order: str, token: str) -> DataFrame:
    """(piece, order, ticks, started, instr, note) of the start and end tokens of the interarrival encoding."""
    w = Window.partitionBy(piece).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = F.col(token)
    rows = tokens.where(t != STEP_SEPARATOR).withColumn("__t", F.sum(F.when(t < START, t).otherwise(0)).over(w)).where(t >= START)
    code = F.when(t < END, t - START).otherwise(t - END)
    instr = F.floor(code / F.lit(PITCHES)).cast("int")
    return rows.select(piece, order, F.col("__t").alias("ticks"), (t < END).alias("started"), instr.alias("instr"), (code - instr * PITCHES).alias("note"))


def on_off_messages(compound: DataFrame, piece: str, order: str) -> DataFrame:
    """(piece, at, kind, order, note, instr, velocity): the messages of compound rows (time, dur, note, instr, velocity), to be
    sent by (at, kind, order): onsets (0) before offsets (1) of the same tick.
    """
    ends = F.array(F.struct(F.col("time").alias("at"), F.lit(0).alias("kind")), F.struct((F.col("time") + F.col("dur")).alias("at"), F.lit(1).alias("kind")))
    return compound.select(piece, order, "note", "instr", "velocity", F.explode(ends).alias("m")).select(piece, "m.at", "m.kind", order, "note", "instr", "velocity")


def windows_across(tokens: DataFrame, order: Sequence[str], token: str, size: int = 1024) -> DataFrame:
    """(window_no, position, token): a whole table of tokens, in order, cut into windows of size; the unfilled last is dropped."""
    from tonearm.operators.catalog import sequence_numbers

    rows = sequence_numbers(tokens, list(order), "__n")
    full = rows.count() // size
    no = F.floor(F.col("__n") / size)
    return rows.where(no < full).select(no.alias("window_no"), (F.col("__n") % size).cast("int").alias("position"), token)


def windows_of_piece(
    df: DataFrame, piece: str, order: str, events: str, events_per_window: int = WINDOW_EVENTS, augmented: str | None = None, keep_ids: bool = False
) -> DataFrame:
    """(piece, window_no, tokens): each piece's sequences one after the other, in windows of a fixed number of events that begin
    with a flag and count time from their first event, with the piece's id as last token if keep_ids.

    A sequence follows ten ticks after the last event held. augmented: a column that is true for sequences with controls; they
    are set off by a separator and keep their own time, and a window's flag tells whether the sequence that it began with is
    one. Windows that run over the time limit have null tokens; what doesn't fill a window is dropped. A piece's events, which
    are those of one work, are read by one task.
    """

    def ends(e: np.ndarray) -> tuple[int, int]:
        """The least time before the first separator, 0 for none, and the largest of all others, at least 0."""
        apart = e[:, 2] == SEPARATOR
        t = np.where(e[:, 2] >= CONTROL, e[:, 0] - CONTROL, e[:, 0])
        first = int(apart.argmax()) if apart.any() else len(e)
        return int(t[:first].min(initial=1 << 40)) if first else 0, int(t[~apart].max(initial=0))

    def moved(e: np.ndarray, dt: int) -> np.ndarray:
        apart = e[:, 2] == SEPARATOR
        out = e.copy()
        out[: int(apart.argmax()) if apart.any() else len(e), 0] += dt
        return out

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        held = np.empty((0, 3), np.int64)
        out, no, flag = [], 0, AUTOREGRESS
        pdf = pdf.sort_values("o", kind="stable")
        for e, own in zip(pdf["e"], pdf["a"]):
            own = ANTICIPATE if own else AUTOREGRESS
            if not len(held):
                flag = own
            e = np.asarray(e, np.int64).reshape(-1, 3)
            if own == ANTICIPATE:
                e = np.concatenate([np.full((1, 3), SEPARATOR), e])
            if len(held):
                e = moved(e, ends(held)[1] + 10)
            held = np.concatenate([held, e])
            full = len(held) // events_per_window
            for i in range(full):
                part = held[i * events_per_window : (i + 1) * events_per_window]
                part = moved(part, -ends(part)[0])
                if ends(part)[1] < MAX_TIME:
                    last = [int(pdf["k"].iloc[0])] if keep_ids else []
                    out.append((pdf["k"].iloc[0], no, [flag, *part.ravel().tolist(), *last]))
                    flag = own
                else:
                    out.append((pdf["k"].iloc[0], no, None))
                no += 1
            held = held[full * events_per_window :]
        return pd.DataFrame(out, columns=["k", "window_no", "tokens"])

    mark = F.coalesce(F.col(augmented).cast("boolean"), F.lit(False)) if augmented else F.lit(False)
    rows = df.select(F.col(piece).alias("k"), F.col(order).alias("o"), mark.alias("a"), flat(events).alias("e"))
    kind = dict(rows.dtypes)["k"]
    return rows.groupBy("k").applyInPandas(run, f"k {kind}, window_no int, tokens array<int>").withColumnRenamed("k", piece)


def tokenizer_stats(tracks: DataFrame, code: str, truncated: str, rests: str, windows: DataFrame, tokens: str = "tokens") -> DataFrame:
    """One row: windows kept, rests added, tracks left out as short, long or with too many instruments, windows out of range, and
    durations cut; the latter and rests of the tracks that are used (code 0).
    """
    used = F.col(code) == 0
    per = tracks.agg(
        F.coalesce(F.sum(F.when(used, F.col(rests))), F.lit(0)).cast("bigint").alias("rests"),
        *(F.count(F.when(F.col(code) == c, 1)).alias(name) for c, name in ((1, "short"), (2, "long"), (3, "too_many_instruments"))),
        F.coalesce(F.sum(F.when(used, F.col(truncated))), F.lit(0)).cast("bigint").alias("truncations"),
    )
    own = windows.agg(F.count(tokens).alias("windows"), F.count(F.when(F.col(tokens).isNull(), 1)).alias("out_of_range"))
    return per.withColumn("__k", F.lit(1)).join(F.broadcast(own.withColumn("__k", F.lit(1))), "__k").drop("__k")


def allowed_token(token: Column, position: Column | int, now: Column | int = 0, instruments: Column | None = None) -> Column:
    """Whether a model may give a token at a position of the sequence: neither control nor special, of the position's kind, a
    time not before now, and, once there are 15 instruments, a note of one of them.
    """
    slot = F.pmod(position if isinstance(position, Column) else F.lit(position), F.lit(3))
    kind = ((slot == 0) & (token < DUR)) | ((slot == 1) & (token >= DUR) & (token < NOTE)) | ((slot == 2) & (token >= NOTE) & (token < NOTE + MAX_NOTE))
    other = (token >= NOTE + MAX_NOTE) & (token < CONTROL)
    ok = (kind | other) & ~((token >= TIME) & (token < now))
    if instruments is not None:
        own = F.floor((token - NOTE) / F.lit(PITCHES)).cast("int")
        note = (token >= NOTE) & (token < NOTE + MAX_NOTE)
        ok = ok & ((F.size(instruments) < 15) | ~note | F.array_contains(instruments, own))
    return ok


def masked_logits(logits: Column | str, position: Column | int, now: Column | int = 0, instruments: Column | None = None) -> Column:
    """Logits with minus infinity where allowed_token() is false."""
    return F.transform(_c(logits), lambda x, i: F.when(allowed_token(i, position, now, instruments), x).otherwise(float("-inf")))


def piano_roll(df: DataFrame, key: str, events: str) -> DataFrame:
    """(key, tick, pitch, instrument): the instrument that sounds at each tick and pitch, of several the later event; drums,
    rests and separators aside, and nothing at or after the last event's time.
    """
    last = max_time(F.col(events))
    notes = df.select(key, last.alias("__last"), F.posexplode(decode(events)).alias("__i", "e")).where((F.col("e.kind") == "note") & (F.col("e.instrument") != 128) & (F.col("e.dur") > 0))
    cells = notes.select(key, "__last", "__i", F.col("e.instrument").alias("instrument"), F.col("e.pitch").alias("pitch"), F.explode(F.sequence(F.col("e.time"), F.col("e.time") + F.col("e.dur") - 1)).alias("tick"))
    return cells.where(F.col("tick") < F.col("__last")).groupBy(key, "tick", "pitch").agg(F.max_by("instrument", "__i").alias("instrument"))


def strip_id(line: Column | str, most: int = 1024, generated: bool = False) -> Column:
    """Tokens of a line of text without its last (an id), or, for generated lines, all of them behind the flag; most at most."""
    parts = F.filter(F.split(F.trim(_c(line)), r"\s+"), lambda x: x != "")
    if generated:
        return F.slice(F.concat(F.array(F.lit(AUTOREGRESS)), F.transform(parts, lambda x: x.cast("int"))), 1, most)
    own = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.slice(F.transform(own, lambda x: x.cast("int")), 1, most)
