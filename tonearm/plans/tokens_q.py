"""Queries of event sequences, code books, draws and streams: T1-T21, A19, A20, W13, V28, R9, R10, S14, streaming A3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.operators import codebooks as cb
from tonearm.operators import ranking as rk
from tonearm.operators import sampling as sm
from tonearm.operators import tokens as tk
from tonearm.plans.bases import SEQUENCE, sequences
from tonearm.plans.registry import core
from tonearm.session import table

_OFF = "CASE WHEN note >= 27513 THEN 27513 ELSE 0 END"


def _rows(df: DataFrame, events) -> DataFrame:
    """piece, pos and the fields of each event."""
    return df.select("piece", F.posexplode(events).alias("pos", "e")).select("piece", "pos", "e.*")


_NUMBERED = "CAST(row_number() OVER (PARTITION BY piece ORDER BY i) - 1 AS INTEGER) AS pos"


@core.add(
    "t01_decode",
    f"""
    WITH {SEQUENCE}, d AS (SELECT piece, i, time, dur, note, control, {_OFF} AS o FROM ev)
    SELECT piece, CAST(i AS INTEGER) AS pos, CAST(time - o AS INTEGER) AS time, CAST(dur - o - 10000 AS INTEGER) AS dur,
           CAST(CASE WHEN note <> 27512 THEN (note - o - 11000) // 128 END AS INTEGER) AS instrument, CAST(CASE WHEN note <> 27512 THEN (note - o - 11000) % 128 END AS INTEGER) AS pitch,
           control, CASE WHEN note = 27512 THEN 'rest' ELSE 'note' END AS kind FROM d
    """,
)
def t01_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times, durations, instruments and pitches of tokens."""
    return _rows(sequences(spark, sf_dir), tk.decode("events"))


@core.add(
    "t02_clip",
    f"""
    WITH {SEQUENCE}, d AS (SELECT *, {_OFF} AS o FROM ev), k AS (SELECT * FROM d WHERE time - o BETWEEN 300 AND 1500)
    SELECT piece, {_NUMBERED}, time, CAST(dur - greatest(time - o + dur - o - 10000 - 1500, 0) AS INTEGER) AS dur, note FROM k
    """,
)
def t02_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events from tick 300 to 1500, both included, durations cut."""
    return _rows(sequences(spark, sf_dir), tk.clip("events", 300, 1500))


@core.add("t03_mask", f"WITH {SEQUENCE}, k AS (SELECT *, {_OFF} AS o FROM ev) SELECT piece, {_NUMBERED}, time, dur, note FROM k WHERE NOT ((time - o) / 100.0 > 3 AND (time - o) / 100.0 < 15)")
def t03_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events without those between three and fifteen seconds."""
    return _rows(sequences(spark, sf_dir), tk.mask("events", 3.0, 15.0))


@core.add("t04_delete", f"WITH {SEQUENCE} SELECT piece, {_NUMBERED}, time, dur, note FROM ev WHERE NOT note % 2 = 0")
def t04_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that a criterion doesn't delete."""
    return _rows(sequences(spark, sf_dir), tk.delete("events", lambda e: e["note"] % 2 == 0))


@core.add("t05_split", f"WITH {SEQUENCE} SELECT piece, CAST(count(CASE WHEN NOT control THEN 1 END) AS INTEGER) AS n_events, CAST(count(CASE WHEN control THEN 1 END) AS INTEGER) AS n_controls FROM ev GROUP BY piece")
def t05_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and controls apart."""
    e, c = tk.split("events")
    return sequences(spark, sf_dir).select("piece", F.size(e).alias("n_events"), F.size(c).alias("n_controls"))


@core.add(
    "t06_pad",
    f"""
    WITH {SEQUENCE}, k AS (SELECT piece, i, time * 5 AS time, coalesce(lag(time * 5) OVER (PARTITION BY piece ORDER BY i), 0) AS before FROM ev WHERE NOT control),
    g AS (SELECT piece, time, CAST(greatest(ceil((time - before) / 100.0) - 1, 0) AS BIGINT) AS n FROM k)
    SELECT piece, CAST(sum(n) AS BIGINT) AS rests, count(*) AS events FROM g GROUP BY piece
    """,
)
def t06_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rests inserted so that no gap is longer than a second, in events played five times slower so that there are gaps."""
    slow = F.transform(F.filter("events", lambda e: ~tk.is_control(e)), lambda e: tk.triple(e["time"] * 5, e["dur"], e["note"]))
    s = sequences(spark, sf_dir).select("piece", slow.alias("e"))
    own = F.size("e")
    padded = tk.pad("e")
    return s.where(own > 0).select("piece", (F.size(padded) - own).cast("bigint").alias("rests"), own.cast("bigint").alias("events"))


@core.add("t07_unpad", f"WITH {SEQUENCE} SELECT piece, {_NUMBERED}, time, dur, note FROM ev WHERE note <> 27512")
def t07_unpad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events without rests."""
    return _rows(sequences(spark, sf_dir), tk.unpad("events"))


@core.add(
    "t08_anticipate",
    f"""
    WITH {SEQUENCE}, e AS (SELECT piece, row_number() OVER w - 1 AS j, time, dur, note, coalesce(lag(time) OVER w, 0) AS clock FROM ev WHERE NOT control WINDOW w AS (PARTITION BY piece ORDER BY i)),
    n AS (SELECT piece, count(CASE WHEN NOT control THEN 1 END) AS n FROM ev GROUP BY piece),
    c AS (SELECT piece, row_number() OVER (PARTITION BY piece ORDER BY i) AS q, time, dur, note FROM ev WHERE control),
    s AS (SELECT c.piece, q, c.time, c.dur, c.note, n.n, coalesce(min(e.j), n.n) AS s FROM c JOIN n ON c.piece = n.piece LEFT JOIN e ON e.piece = c.piece AND e.clock >= c.time - 27513 - 500 GROUP BY c.piece, q, c.time, c.dur, c.note, n.n),
    r AS (SELECT *, max(s) OVER (PARTITION BY piece ORDER BY q ROWS UNBOUNDED PRECEDING) AS slot FROM s),
    k AS (SELECT piece, slot AS j, 0 AS kind, q, time, dur, note FROM r WHERE slot < n UNION ALL SELECT piece, j, 1, 0, time, dur, note FROM e),
    t AS (SELECT piece, flatten(list([time, dur, note] ORDER BY j, kind, q)) AS tokens FROM k GROUP BY piece)
    SELECT n.piece, coalesce(tokens, []) AS tokens, CAST((SELECT count(*) FROM r WHERE r.piece = n.piece AND r.slot >= n.n) AS INTEGER) AS n_left FROM n LEFT JOIN t ON t.piece = n.piece
    """,
)
def t08_anticipate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Controls woven in ahead of their time, and those left over."""
    e, c = tk.split("events")
    tokens, left = tk.anticipate("e", "c")
    s = sequences(spark, sf_dir).select("piece", e.alias("e"), c.alias("c"))
    return s.select("piece", tk.flat(tokens).alias("tokens"), F.size(left).alias("n_left"))


@core.add(
    "t09_extreme_times",
    f"""
    WITH {SEQUENCE}, d AS (SELECT piece, time - {_OFF} AS t, CAST(floor((note - {_OFF} - 11000) / 128.0) AS INTEGER) AS instr FROM ev)
    SELECT piece, CAST(min(t) AS INTEGER) AS first, CAST(greatest(max(t), 0) AS INTEGER) AS last, CAST(coalesce(min(CASE WHEN instr = 3 THEN t END), 0) AS INTEGER) AS first_of_3 FROM d GROUP BY piece
    """,
)
def t09_extreme_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last time, of all and of one instrument."""
    return sequences(spark, sf_dir).select("piece", tk.min_time("events").alias("first"), tk.max_time("events").alias("last"), tk.min_time("events", 3).alias("first_of_3"))


@core.add(
    "t10_translate",
    f"WITH {SEQUENCE} SELECT piece, CAST(i AS INTEGER) AS pos, CAST(CASE WHEN i < 10 THEN time + 250 ELSE time END AS INTEGER) AS time, dur, note FROM ev WHERE i <> 10 UNION ALL SELECT piece, 10, 55025, 55025, 55025 FROM ev WHERE i = 10",
)
def t10_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times moved up to the first separator."""
    sep = tk.triple(F.lit(tk.SEPARATOR), F.lit(tk.SEPARATOR), F.lit(tk.SEPARATOR))
    events = F.transform("events", lambda e, i: F.when(i == 10, sep).otherwise(e))
    return _rows(sequences(spark, sf_dir), tk.translate(events, 250))


@core.add(
    "t11_combine",
    f"""
    WITH {SEQUENCE}, d AS (SELECT piece, i, control, CAST(time - {_OFF} AS INTEGER) AS time, CAST(dur - {_OFF} AS INTEGER) AS dur, CAST(note - {_OFF} AS INTEGER) AS note FROM ev)
    SELECT piece, CAST(row_number() OVER (PARTITION BY piece ORDER BY time, control, i) - 1 AS INTEGER) AS pos, time, dur, note FROM d
    """,
)
def t11_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and controls in one, by time."""
    return _rows(sequences(spark, sf_dir), tk.combine(*tk.split("events")))


_COMPOUND = """
    sq AS (SELECT user_id AS piece, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events WHERE user_id IS NOT NULL),
    cp AS (SELECT piece, CAST(i AS INTEGER) AS i, CAST(i * 40 AS INTEGER) AS time, CAST(CASE WHEN event_id % 6 = 0 THEN -1 ELSE floor(abs(value) * 30) END AS INTEGER) AS dur,
                  CAST((event_id * 7) % 128 AS INTEGER) AS note, CAST(event_id % 129 AS INTEGER) AS instr, 90 AS velocity FROM sq)
"""


def _compound(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    k = F.col("event_id")
    e = table(spark, sf_dir, "events").where("user_id is not null")
    i = (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).alias("i")
    rows = e.select(F.col("user_id").alias("piece"), i, "event_id", "value")
    word = F.struct(
        (F.col("i") * 40).cast("int").alias("time"),
        F.when(k % 6 == 0, -1).otherwise(F.floor(F.abs("value") * 30)).cast("int").alias("dur"),
        ((k * 7) % 128).cast("int").alias("note"),
        (k % 129).cast("int").alias("instr"),
        F.lit(90).alias("velocity"),
    )
    lists = rows.groupBy("piece").agg(F.array_sort(F.collect_list(F.struct("i", word.alias("w")))).alias("s"))
    return lists.select("piece", F.transform("s", lambda s: s["w"]).alias("words"))


@core.add(
    "t12_compound_to_events",
    f"""
    WITH {_COMPOUND} SELECT piece, i AS pos, time, CAST(10000 + CASE WHEN dur = -1 THEN 25 ELSE least(dur, 999) END AS INTEGER) AS dur, CAST(11000 + 128 * instr + note AS INTEGER) AS note FROM cp
    """,
)
def t12_compound_to_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compound events as triples."""
    return _rows(_compound(spark, sf_dir), tk.compound_to_events("words")[0])


@core.add("a20_tokenizer_stats", f"WITH {_COMPOUND} SELECT piece, CAST(count(CASE WHEN dur >= 1000 THEN 1 END) AS INTEGER) AS truncated, CAST(0 AS INTEGER) + CASE WHEN count(*) < 10 OR max(time) < 100 THEN 1 WHEN max(time) > 360000 THEN 2 WHEN count(DISTINCT instr) > 16 THEN 3 ELSE 0 END AS code FROM cp GROUP BY piece")
def a20_tokenizer_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations cut and the reason why a track is left out."""
    return _compound(spark, sf_dir).select("piece", tk.compound_to_events("words")[1].alias("truncated"), tk.gate("words").alias("code"))


@core.add(
    "t13_events_to_compound",
    f"""
    WITH {SEQUENCE} SELECT piece, CAST(row_number() OVER (PARTITION BY piece ORDER BY i) - 1 AS INTEGER) AS pos, CAST(time - {_OFF} AS INTEGER) AS time, CAST(dur - {_OFF} - 10000 AS INTEGER) AS dur,
           CAST((note - {_OFF} - 11000) % 128 AS INTEGER) AS note, CAST((note - {_OFF} - 11000) // 128 AS INTEGER) AS instr, 72 AS velocity FROM ev WHERE note <> 27512
    """,
)
def t13_events_to_compound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples as compound events."""
    return _rows(sequences(spark, sf_dir), tk.events_to_compound("events"))


@core.add(
    "a19_instrument_counts",
    f"WITH {SEQUENCE} SELECT piece, CAST((note - {_OFF} - 11000) // 128 AS INTEGER) AS instrument, CAST(count(*) AS INTEGER) AS n FROM ev GROUP BY ALL",
)
def a19_instrument_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each instrument."""
    return sequences(spark, sf_dir).select("piece", F.explode(tk.instrument_counts("events")).alias("instrument", "n"))


@core.add(
    "w13_largest_gap",
    f"WITH {SEQUENCE}, g AS (SELECT piece, time - coalesce(lag(time) OVER (PARTITION BY piece ORDER BY i), 0) AS g FROM ev WHERE NOT control) SELECT piece, CAST(greatest(max(g), 0) AS INTEGER) AS max_gap FROM g GROUP BY piece",
)
def w13_largest_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest wait between events of a sequence."""
    s = sequences(spark, sf_dir).select("piece", tk.split("events")[0].alias("e"))
    return s.where(F.size("e") > 0).select("piece", tk.sparsity("e").alias("max_gap"))


@core.add(
    "w13_largest_gap_rows",
    "WITH g AS (SELECT user_id, event_id - coalesce(lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS g FROM events) SELECT user_id, greatest(max(g), 0) AS max_gap FROM g GROUP BY user_id",
)
def w13_largest_gap_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of rows."""
    return rk.largest_gap(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], "event_id", ["event_id"])


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf_dir, "events").where("user_id is not null").select(
        F.col("user_id").alias("piece"), k.alias("seq"), (k / 64.0).alias("t"), ((k * 13) % 5 < 2).alias("on"), (k % 3).cast("int").alias("instr"), (k % 4 + 60).cast("int").alias("note"), F.lit(0).alias("channel")
    )


@core.add(
    "t14_pair_notes",
    """
    WITH RECURSIVE m AS (SELECT user_id AS piece, event_id AS seq, event_id / 64.0::DOUBLE AS t, (event_id * 13) % 5 < 2 AS started, CAST(event_id % 3 AS INTEGER) AS instr, CAST(event_id % 4 + 60 AS INTEGER) AS note FROM events WHERE user_id IS NOT NULL),
    n AS (SELECT *, row_number() OVER (PARTITION BY piece, instr, note ORDER BY seq) AS k FROM m),
    q AS (SELECT piece, instr, note, k, CASE WHEN started THEN [seq] ELSE CAST([] AS BIGINT[]) END AS waiting, CAST(NULL AS BIGINT) AS onset, CAST(NULL AS DOUBLE) AS ended FROM n WHERE k = 1
          UNION ALL
          SELECT n.piece, n.instr, n.note, n.k, CASE WHEN started THEN list_append(waiting, seq) ELSE waiting[2:] END, CASE WHEN NOT started THEN waiting[1] END, CASE WHEN NOT started AND len(waiting) > 0 THEN t END
          FROM q JOIN n ON q.piece = n.piece AND q.instr = n.instr AND q.note = n.note AND n.k = q.k + 1)
    SELECT m.piece, m.instr, m.note, 0 AS channel, m.seq AS onset_order, m.t AS onset, coalesce(CAST(round_even(100 * (q.ended - m.t), 0) AS INTEGER), -1) AS dur_ticks
    FROM m LEFT JOIN q ON q.onset = m.seq AND q.piece = m.piece WHERE m.started
    """,
)
def t14_pair_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Note-ons with the note-off that ends them."""
    return tk.pair_notes(_messages(spark, sf_dir), "piece", "seq", "t", "on", ["instr", "note", "channel"])


@core.add(
    "t15_steps",
    """
    WITH m AS (SELECT user_id AS piece, event_id AS seq, event_id / 64.0::DOUBLE AS t, (event_id * 13) % 5 < 2 AS on_, event_id % 3 AS instr, event_id % 4 + 60 AS note FROM events WHERE user_id IS NOT NULL),
    s AS (SELECT *, CAST(least(round_even(100 * (t - coalesce(lag(t) OVER (PARTITION BY piece ORDER BY seq), 0)), 0), 999) AS INTEGER) AS step FROM m)
    SELECT piece, seq, 0 AS part, step AS token FROM s WHERE step > 0 UNION ALL
    SELECT piece, seq, 1, CAST(CASE WHEN on_ THEN 1000 ELSE 17512 END + 128 * instr + note AS INTEGER) FROM s
    """,
)
def t15_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interarrival encoding of messages."""
    return tk.to_steps(_messages(spark, sf_dir), "piece", "seq", "t", "on", "instr", "note")


@core.add(
    "t15_steps_back",
    """
    WITH m AS (SELECT user_id AS piece, event_id AS seq, event_id / 64.0::DOUBLE AS t, (event_id * 13) % 5 < 2 AS started, event_id % 3 AS instr, event_id % 4 + 60 AS note FROM events WHERE user_id IS NOT NULL),
    s AS (SELECT *, CAST(least(round_even(100 * (t - coalesce(lag(t) OVER (PARTITION BY piece ORDER BY seq), 0)), 0), 999) AS BIGINT) AS step FROM m)
    SELECT piece, seq * 2 + 1 AS at, CAST(sum(step) OVER (PARTITION BY piece ORDER BY seq) AS BIGINT) AS ticks, started, CAST(instr AS INTEGER) AS instr, CAST(note AS INTEGER) AS note FROM s
    """,
)
def t15_steps_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages decoded from their interarrival encoding."""
    t = tk.to_steps(_messages(spark, sf_dir), "piece", "seq", "t", "on", "instr", "note").withColumn("at", F.col("seq") * 2 + F.col("part"))
    return tk.from_steps(t, "piece", "at", "token")


@core.add(
    "t16_messages",
    f"""
    WITH {_COMPOUND} SELECT piece, time AS at, 0 AS kind, i, note, instr, velocity FROM cp UNION ALL SELECT piece, time + dur, 1, i, note, instr, velocity FROM cp
    """,
)
def t16_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On and off messages of compound events, onsets first at equal ticks."""
    rows = _compound(spark, sf_dir).select("piece", F.posexplode("words").alias("i", "w")).select("piece", "i", "w.*")
    return tk.on_off_messages(rows, "piece", "i").orderBy("piece", "at", "kind", "i")


@core.add(
    "t17_extraction",
    f"""
    WITH {SEQUENCE}, e AS (SELECT piece, (note - 11000) // 128 AS instr, row_number() OVER (PARTITION BY piece ORDER BY i) - 1 AS k FROM ev WHERE NOT control AND note <> 27512)
    SELECT p.piece, CAST(count(e.piece) AS INTEGER) AS n, CAST(count(CASE WHEN instr IN (3, 14) THEN 1 END) AS INTEGER) AS chosen,
           CAST(count(CASE WHEN ('0x' || md5('5|' || e.piece || '|' || k)[1:10])::BIGINT / 1099511627776.0 < 0.3 THEN 1 END) AS INTEGER) AS random
    FROM (SELECT DISTINCT piece FROM ev) p LEFT JOIN e ON e.piece = p.piece GROUP BY p.piece
    """,
)
def t17_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events turned into controls: those of chosen instruments, and at random."""
    s = sequences(spark, sf_dir).select("piece", tk.unpad(tk.split("events")[0]).alias("e"))
    a, b = tk.extract_instruments("e", F.array(F.lit(3), F.lit(14))), tk.extract_random("e", F.col("piece"), 3.0, 5)
    return s.select("piece", F.size("e").alias("n"), F.size(a[1]).alias("chosen"), F.size(b[1]).alias("random"))


@core.add(
    "t17_spans",
    f"""
    WITH RECURSIVE {SEQUENCE}, e AS (SELECT piece, time, row_number() OVER (PARTITION BY piece ORDER BY i) AS k FROM ev WHERE NOT control AND note <> 27512),
    q(piece, k, spanned, nxt, fin, no, hits) AS (
        SELECT DISTINCT piece, CAST(0 AS BIGINT), true, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM ev UNION ALL
        SELECT piece, k, (spanned AND NOT ended) OR begins, nxt, CASE WHEN begins THEN time + 500 ELSE fin END, no, hits + CASE WHEN (spanned AND NOT ended) OR begins THEN 1 ELSE 0 END
        FROM (SELECT *, NOT (spanned AND NOT ended) AND time >= nxt AS begins
              FROM (SELECT q.piece, e.k, e.time, q.spanned, q.fin, q.hits, q.spanned AND e.time >= q.fin AS ended, q.no + CASE WHEN q.spanned AND e.time >= q.fin THEN 1 ELSE 0 END AS no,
                           CASE WHEN q.spanned AND e.time >= q.fin
                                THEN e.time + CAST(floor(-100 * ln(1 - ('0x' || md5('5|' || q.piece || '|' || q.no)[1:10])::BIGINT / 1099511627776.0) / 0.05) AS BIGINT) ELSE q.nxt END AS nxt
                    FROM q JOIN e ON e.piece = q.piece AND e.k = q.k + 1)))
    SELECT piece, CAST(arg_max(hits, k) AS INTEGER) AS spans FROM q GROUP BY piece
    """,
)
def t17_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events turned into controls in spans after exponential waits."""
    s = sequences(spark, sf_dir).select("piece", tk.unpad(tk.split("events")[0]).alias("e"))
    return tk.extract_spans(s, "piece", "e", 0.05, 5).select("piece", (F.size("controls") / 3).cast("int").alias("spans"))


_WORKS = f"""
    {SEQUENCE}, w0 AS (SELECT piece % 10 AS work, piece, i, time, dur, note, coalesce(lag(time) OVER (PARTITION BY piece ORDER BY i), 0) AS before FROM ev WHERE NOT control AND note <> 27512),
    w1 AS (SELECT work, piece, i, 1 AS kind, time, dur, note FROM w0 UNION ALL SELECT work, piece, i, 0, unnest(range(before + 20, time, 20)), 10000, 27512 FROM w0 WHERE time > before + 20),
    w2 AS (SELECT *, row_number() OVER (PARTITION BY piece ORDER BY i, kind, time) - 1 AS pos FROM w1),
    pc AS (SELECT work, piece, count(*) AS n, max(time) AS last, row_number() OVER (PARTITION BY work ORDER BY piece) AS k, sum(count(*)) OVER (PARTITION BY work ORDER BY piece) AS upto FROM w2 GROUP BY work, piece),
    sh(work, k, shift) AS (SELECT work, k, CAST(0 AS BIGINT) FROM pc WHERE k = 1 UNION ALL
        SELECT pc.work, pc.k, CASE WHEN a.upto % 341 = 0 THEN 0 ELSE sh.shift + a.last + 10 END FROM sh JOIN pc a ON a.work = sh.work AND a.k = sh.k JOIN pc ON pc.work = sh.work AND pc.k = sh.k + 1),
    al AS (SELECT w2.work, CAST((upto - n + pos) // 341 AS INTEGER) AS window_no, upto - n + pos AS at_, w2.time + shift AS time, dur, note FROM w2 JOIN pc USING (piece) JOIN sh ON sh.work = pc.work AND sh.k = pc.k),
    wi AS (SELECT work, window_no, min(time) AS low, max(time) AS high FROM al GROUP BY work, window_no HAVING count(*) = 341)
"""


@core.add(
    "t18_piece_windows",
    f"""
    WITH RECURSIVE {_WORKS}
    SELECT wi.work, wi.window_no, CASE WHEN any_value(high - low) < 10000 THEN list_concat([55026], flatten(list([CAST(time - low AS INTEGER), dur, note] ORDER BY at_))) END AS tokens
    FROM wi JOIN al USING (work, window_no) GROUP BY wi.work, wi.window_no
    """,
)
def t18_piece_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of a piece packed in windows of 341 events."""
    s = sequences(spark, sf_dir).select((F.col("piece") % 10).alias("work"), F.col("piece"), tk.pad(tk.unpad(tk.split("events")[0]), density=20).alias("e"))
    return tk.windows_of_piece(s, "work", "piece", "e")


@core.add("t18_augmented_windows")
def t18_augmented_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with each sequence twice: as it is, and with chosen instruments as controls ahead of their time."""
    s = sequences(spark, sf_dir).select("piece", tk.unpad(tk.split("events")[0]).alias("e"))
    end = tk.max_time("e")
    plain = s.select("piece", F.lit(0).alias("k"), tk.pad("e", density=20).alias("tokens"))
    own, controls = tk.extract_instruments("e", F.sequence(F.lit(0), F.lit(40)))
    both = s.select("piece", end.alias("end"), own.alias("own"), controls.alias("controls"))
    woven = tk.anticipate(tk.pad("own", F.col("end"), 20), "controls")[0]
    rows = plain.union(both.select("piece", F.lit(1), woven))
    rows = rows.select((F.col("piece") % 10).alias("work"), (F.col("piece") * 2 + F.col("k")).alias("at"), (F.col("k") == 1).alias("augmented"), "tokens")
    return tk.windows_of_piece(rows, "work", "at", "tokens", augmented="augmented", keep_ids=True)


@core.add(
    "a20_run_stats",
    f"""
    WITH {_COMPOUND}, t AS (SELECT piece, count(*) AS n, count(CASE WHEN dur >= 1000 THEN 1 END) AS cut,
         CASE WHEN count(*) < 10 OR max(time) < 100 THEN 1 WHEN max(time) > 2800 THEN 2 WHEN count(DISTINCT instr % 17) > 16 THEN 3 ELSE 0 END AS code FROM cp GROUP BY piece),
    w AS (SELECT piece % 10 AS work, sum(2 * n - 1) // 341 AS windows FROM t WHERE code = 0 GROUP BY work)
    SELECT CAST(coalesce(sum(CASE WHEN code = 0 THEN n - 1 END), 0) AS BIGINT) AS rests, count(CASE WHEN code = 1 THEN 1 END) AS short, count(CASE WHEN code = 2 THEN 1 END) AS long,
           count(CASE WHEN code = 3 THEN 1 END) AS too_many_instruments, CAST(coalesce(sum(CASE WHEN code = 0 THEN cut END), 0) AS BIGINT) AS truncations,
           CAST(coalesce((SELECT sum(windows) FROM w), 0) AS BIGINT) AS windows, CAST(0 AS BIGINT) AS out_of_range FROM t
    """,
)
def a20_run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of a tokenizer's run: what is kept, padded, left out for which reason, and cut."""
    fewer = F.transform("words", lambda w: w.withField("instr", F.pmod(w["instr"], F.lit(17))))
    c = _compound(spark, sf_dir).select("piece", fewer.alias("words"))
    events, cut_ = tk.compound_to_events("words")
    t = c.select("piece", tk.gate("words", most_seconds=28).alias("code"), cut_.alias("truncated"), events.alias("e"))
    t = t.select("piece", "code", "truncated", tk.pad("e", density=25).alias("padded"), F.size("e").alias("n"))
    t = t.withColumn("rests", F.size("padded") - F.col("n"))
    used = t.where("code = 0").select((F.col("piece") % 10).alias("work"), "piece", "padded")
    return tk.tokenizer_stats(t, "code", "truncated", "rests", tk.windows_of_piece(used, "work", "piece", "padded"))


@core.add(
    "t22_logit_masks",
    """
    WITH t AS (SELECT n_nationkey AS k, unnest(range(55028)) AS t FROM nation),
    a AS (SELECT k, t FROM t WHERE t < 27513 AND NOT t < 10 * k AND ((k % 3 = 0 AND t < 10000) OR (k % 3 = 1 AND t >= 10000 AND t < 11000) OR (k % 3 = 2 AND t >= 11000 AND t < 27512) OR t = 27512)
          AND (k < 14 OR t < 11000 OR t >= 27512 OR (t - 11000) // 128 <= k))
    SELECT k AS n_nationkey, CAST(count(*) AS INTEGER) AS n, CAST(sum(t) AS DOUBLE) AS total FROM a GROUP BY k
    """,
)
def t22_logit_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model may give next: by slot, time and instruments."""
    k = F.col("n_nationkey")
    logits = F.transform(F.sequence(F.lit(0), F.lit(tk.ANTICIPATE)), lambda i: i.cast("double"))
    masked = tk.masked_logits(logits, k, k * 10, F.sequence(F.lit(0), k.cast("int")))
    kept = F.filter(masked, lambda x: x > float("-inf"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", kept.alias("kept"))
    return n.select("n_nationkey", F.size("kept").alias("n"), F.aggregate("kept", F.lit(0.0), lambda s, x: s + x).alias("total"))


@core.add(
    "t19_windows_across",
    "WITH t AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS n, event_id AS token FROM events) SELECT n // 1024 AS window_no, CAST(n % 1024 AS INTEGER) AS position, token FROM t WHERE n // 1024 < (SELECT count(*) // 1024 FROM t)",
)
def t19_windows_across(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of tokens in windows of 1,024 across pieces."""
    return tk.windows_across(table(spark, sf_dir, "events").select(F.col("event_id").alias("token")), ["token"], "token")


@core.add(
    "t20_piano_roll",
    f"""
    WITH {SEQUENCE}, d AS (SELECT piece, i, time - {_OFF} AS t, dur - {_OFF} - 10000 AS d, (note - {_OFF} - 11000) // 128 AS instr, (note - {_OFF} - 11000) % 128 AS pitch, note, max(time - {_OFF}) OVER (PARTITION BY piece) AS last FROM ev),
    c AS (SELECT piece, i, instr, pitch, last, unnest(range(t, t + d)) AS tick FROM d WHERE note <> 27512 AND instr <> 128 AND d > 0)
    SELECT piece, CAST(tick AS INTEGER) AS tick, CAST(pitch AS INTEGER) AS pitch, CAST(arg_max(instr, i) AS INTEGER) AS instrument FROM c WHERE tick < last GROUP BY piece, tick, pitch
    """,
)
def t20_piano_roll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What sounds at each tick and pitch."""
    return tk.piano_roll(sequences(spark, sf_dir), "piece", "events")


@core.add(
    "t21_first_queries",
    r"""
    SELECT 'query_' || lpad(CAST(doc_id AS VARCHAR), 4, '0') AS prompt_id, doc_id AS query_index, CAST(len(string_split(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')), ' ')) AS INTEGER) AS num_tokens
    FROM documents WHERE doc_id < 300 AND trim(text) <> ''
    """,
)
def t21_first_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 300 lines as queries; blank ones use up a number."""
    from tonearm.sources.text import first_queries

    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("line_no"), F.col("text").alias("value"))
    return first_queries(d, 300).select("prompt_id", "query_index", "num_tokens")


@core.add(
    "s14_token_dataset",
    "SELECT l_orderkey * 8 + l_linenumber AS k, CAST(l_partkey AS INTEGER) AS first, CAST(2 AS INTEGER) AS n, 55026 AS flag, CAST(4 AS INTEGER) AS n_generated FROM lineitem",
)
def s14_token_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token lines without their id, or behind the flag of generated ones."""
    line = F.concat_ws(" ", F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_suppkey").cast("string"))
    own, made = tk.strip_id(line), tk.strip_id(line, generated=True)
    li = table(spark, sf_dir, "lineitem").withColumns({"own": own, "made": made})
    return li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"), F.get("own", 0).alias("first"), F.size("own").alias("n"), F.get("made", 0).alias("flag"), F.size("made").alias("n_generated"))


_GRID = "g AS (SELECT CAST(q AS INTEGER) AS book, CAST(t AS INTEGER) AS frame FROM range(4) a(q), range(50) b(t))"


@core.add(
    "v28_layouts",
    f"""
    WITH {_GRID}
    SELECT 'delayed' AS kind, CAST(1 + frame + book AS INTEGER) AS step, book, frame FROM g UNION ALL
    SELECT 'parallel', CAST(1 + frame AS INTEGER), book, frame FROM g UNION ALL
    SELECT 'unrolled', CAST(1 + frame * 4 + book AS INTEGER), book, frame FROM g UNION ALL
    SELECT 'coarse', CAST(CASE WHEN book = 0 THEN 1 + frame ELSE 51 + frame + book - 1 END AS INTEGER), book, frame FROM g UNION ALL
    SELECT 'grouped', CAST(1 + (book // 2) * 100 + frame * 2 + book % 2 AS INTEGER), book, frame FROM g
    """,
)
def v28_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layouts of four code books over fifty frames."""
    made = {
        "delayed": cb.delayed(spark, 4, 50),
        "parallel": cb.parallel(spark, 4, 50),
        "unrolled": cb.unrolled(spark, 4, 50),
        "coarse": cb.coarse_first(spark, 4, 50, [0, 1, 2]),
        "grouped": cb.grouped(spark, 4, 50, 2),
    }
    out = None
    for kind, layout in made.items():
        one = layout.select(F.lit(kind).alias("kind"), "step", "book", "frame")
        out = one if out is None else out.union(one)
    return out


def _book_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where("l_linenumber between 1 and 4")
    cells = li.groupBy((F.col("l_suppkey")).alias("id"), (F.col("l_linenumber") - 1).alias("book"), (F.col("l_partkey") % 20).cast("int").alias("frame"))
    return cells.agg(F.max("l_orderkey").alias("code"))


_BOOKS = "c AS (SELECT l_suppkey AS id, CAST(l_linenumber - 1 AS INTEGER) AS book, CAST(l_partkey % 20 AS INTEGER) AS frame, max(l_orderkey) AS code FROM lineitem WHERE l_linenumber BETWEEN 1 AND 4 GROUP BY ALL)"


@core.add(
    "v28_build",
    f"""
    WITH {_BOOKS}, g AS (SELECT id, CAST(b AS INTEGER) AS book, CAST(s AS INTEGER) AS step FROM (SELECT DISTINCT id FROM c), range(4) x(b), range(24) y(s))
    SELECT g.id, g.book, g.step, coalesce(code, -1) AS code FROM g LEFT JOIN c ON c.id = g.id AND c.book = g.book AND c.frame + c.book + 1 = g.step
    """,
)
def v28_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes in a delayed layout, special codes elsewhere."""
    return cb.build(_book_codes(spark, sf_dir), cb.delayed(spark, 4, 20), 4, -1, 24)


@core.add(
    "v28_revert",
    f"""
    WITH {_BOOKS}, g AS (SELECT id, CAST(b AS INTEGER) AS book, CAST(f AS INTEGER) AS frame FROM (SELECT DISTINCT id FROM c), range(4) x(b), range(20) y(f))
    SELECT g.id, g.book, g.frame, coalesce(code, -1) AS code FROM g LEFT JOIN c ON c.id = g.id AND c.book = g.book AND c.frame = g.frame
    """,
)
def v28_revert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """And back again."""
    layout = cb.delayed(spark, 4, 20)
    return cb.revert(cb.build(_book_codes(spark, sf_dir), layout, 4, -1), layout, -1)


@core.add(
    "r09_inpaint_masks",
    """
    WITH d AS (SELECT event_id AS k, CAST(event_id % 41 AS INTEGER) AS n, [('0x' || md5(s || '|' || event_id)[1:10])::BIGINT / 1099511627776.0 FOR s IN ['3', '4', '7']] AS u FROM events),
    g AS (SELECT *, CAST(1 + floor(u[2] * 10) AS BIGINT) AS c FROM d),
    s AS (SELECT *, [{'i': i, 'n': 1 + floor(('0x' || md5('5|' || k || '|' || i)[1:10])::BIGINT / 1099511627776.0 * greatest(1, floor(n / c))), 'v': ('0x' || md5('6|' || k || '|' || i)[1:10])::BIGINT / 1099511627776.0} FOR i IN range(1, c + 1)] AS r FROM g),
    t AS (SELECT *, list_transform(list_filter(r, lambda x: x.n <= n), lambda x: {'a': floor(x.v * (greatest(n - x.n, 0) + 1)), 'n': x.n}) AS w FROM s)
    SELECT k AS event_id, CASE WHEN u[1] >= 0.4 AND u[1] < 0.4 + 0.2 THEN list_transform(range(40), lambda p: 0) WHEN n = 0 THEN list_transform(range(40), lambda p: 1)
           WHEN u[1] < 0.4 THEN list_transform(range(40), lambda p: CASE WHEN len(list_filter(w, lambda x: p >= x.a AND p < x.a + x.n)) > 0 THEN 0 ELSE 1 END)
           ELSE list_transform(range(40), lambda p: CASE WHEN p >= floor(u[3] * (n + 1)) AND p < n THEN 0 ELSE 1 END) END AS mask FROM t
    """,
)
def r09_inpaint_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded masks: segments, all, or what follows a prefix."""
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", sm.inpaint_mask(k, F.lit(40), (k % 41).cast("int"), 3, (0.4, 0.2, 0.4)).alias("mask"))


_DRAW = "('0x' || md5('{}|' || event_id)[1:10])::BIGINT / 1099511627776.0"
_NORMAL = f"sqrt(-2 * ln(greatest({_DRAW.format('{0}')}, 1e-12))) * cos(2 * pi() * {_DRAW.format('{1}')})"


@core.add(
    "r10_timesteps",
    f"""
    WITH z AS (SELECT event_id, {_NORMAL.format(11, 7930)} AS z, {_NORMAL.format(12, 7931)} AS y FROM events)
    SELECT event_id, round(least(greatest(1 / (1 + exp(z * 2.0 - 1.2)), 1e-4), 1 - 1e-4), 9) AS t FROM z
    """,
)
def r10_timesteps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded times by their log signal-to-noise ratio."""
    return table(spark, sf_dir, "events").select("event_id", F.round(sm.logsnr_time(11, F.col("event_id")), 9).alias("t"))


@core.add(
    "r10_truncated_times",
    "SELECT event_id, true AS inside, true AS quantile_fits FROM events",
)
def r10_truncated_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded truncated logistic-normal times: within [0, 1), and their distribution function at the time is the draw."""
    from tonearm.functions.scalar import draw

    left = 0.075
    low = sm.bound_of(left)
    u, z = draw(13, F.col("event_id")), F.log((F.col("t") * (1 - left) + left) / (1 - (F.col("t") * (1 - left) + left)))
    e = table(spark, sf_dir, "events").select("event_id", sm.truncated_time(13, F.col("event_id"), left).alias("t"), (F.lit(low) + (1 - low) * u).alias("p"))
    fits = F.abs(sm.normal_distribution(z) - F.col("p")) < 1e-6
    return e.select("event_id", ((F.col("t") >= -1e-9) & (F.col("t") < 1)).alias("inside"), fits.alias("quantile_fits"))


@core.add(
    "stream_windowed_sums",
    "SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL",
)
def stream_windowed_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly sums by type over the events as a stream, with a watermark (an extension)."""
    from tonearm.storage import scratch
    from tonearm.streaming.rollup import event_stream, latest, run_to_table, windowed_sums

    root = scratch(spark, "stream")
    s = windowed_sums(event_stream(spark, sf_dir, "events.parquet"), "ts", ["event_type"], "value", "1 hour", "10 minutes")
    run_to_table(s, f"{root}/out", f"{root}/state")
    return latest(s, f"{root}/out", ["event_type"]).withColumns({"total": F.round("total", 6), "window_start": F.col("window_start").cast("timestamp_ntz")})
