"""Several values packed in one field: dictionary-guided segmentation.

A first pass over all rows counts the pieces that stand alone between delimiters or inside quotes and keeps those with
enough support: the dictionary of known whole values. A second pass finds all known values in a field with a multi-pattern
automaton and picks, by dynamic programming, the best cover of the field by known values, quoted values, unknown pieces and
delimiters. A delimiter inside a known or quoted value is thereby protected, and a blank separates only where that
explains the field better than one value with a blank in it.

Both passes are one Arrow exchange without a shuffle of rows; only the counts are shuffled, after being summed per batch.
A dictionary of more values or characters than can be sent to the executors stays a table: the parts of the different fields
that may be values are joined to it, and each field is covered by the known values that stand in it, with the same result.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonearm.operators.skew import join_unique
from tonearm.storage import cut

#: Delimiters that always separate, outside quotes and known values. A slash separates only between blanks.
STRONG = re.compile(r"[\t\r\n,;|]|(?<=\s)/(?=\s)")
_PIECE = re.compile(
    r"""\s*(?:"(?:[^"\\]|\\.|"")*"|'(?:[^'\\]|\\.)*')(?=\s*(?:[\t\r\n,;|\]]|$|/\s))"""
    r"""|[^\t\r\n,;|/]+(?:(?:/(?!\s)|(?<!\s)/)[^\t\r\n,;|/]*)*"""
)
_SKIP = re.compile(r"[\s,;|]*(?:/(?=\s|$)[\s,;|]*)*")
_AFTER = re.compile(r"\s*(?:[\t\r\n,;|\]]|$|/\s)")
_BLANK = re.compile(r"\s+")

#: Scores of a cover, as log probabilities: an unknown piece costs more than any known value, and more the longer it is;
#: an unknown quoted value costs less, but grows with its length too, as a stray mark may seem to quote a whole row of values.
UNKNOWN, UNKNOWN_CHAR, QUOTED, QUOTED_CHAR, BLANK_CUT = -20.0, -1.5, -14.0, -0.4, -2.0
#: A dictionary of up to so many values and characters is sent to the executors.
SENT_VALUES, SENT_CHARS = 1_000_000, 64_000_000


def _unquote(s: str) -> str:
    q, s = s[0], s[1:-1]
    if "\\" in s:
        s = re.sub(r"\\(.)", r"\1", s)
    return s.replace(q + q, q).strip()


def _strip_list(s: str) -> str:
    """Without the brackets that enclose a whole field."""
    t = s.strip()
    if len(t) > 1 and (t[0], t[-1]) in (("[", "]"), ("(", ")"), ("{", "}")):
        return t[1:-1]
    return s


class Cover:
    """Splits fields by the best cover. values: log probability by known value."""

    def __init__(self, values: dict[str, float]):
        import ahocorasick

        self.values, self.memo = values, {}
        self.known = ahocorasick.Automaton()
        self.protected = ahocorasick.Automaton()
        for v, p in values.items():
            self.known.add_word(v, (len(v), p))
            if STRONG.search(v):
                self.protected.add_word(v, True)
        for a in (self.known, self.protected):
            if len(a):
                a.make_automaton()
        self.any_known, self.any_protected = len(self.known) > 0, len(self.protected) > 0

    def split(self, field: str) -> list[str]:
        """The values of one field, in order; empty values are none."""
        field = _strip_list(field)
        if '"' in field or "'" in field or (self.any_protected and next(self.protected.iter(field), None)):
            return self.cover(field)
        out = []
        for piece in STRONG.split(field):
            got = self.memo.get(piece)
            if got is None:
                if len(self.memo) > 200_000:
                    self.memo.clear()
                got = self.memo[piece] = self.cover(piece)
            out += got
        return out

    def cover(self, s: str) -> list[str]:
        n = len(s)
        starts: dict[int, list[tuple[int, float]]] = {}
        if self.any_known:
            for end, (size, p) in self.known.iter(s):
                e = end + 1
                if e == n or s[e] in "\t\r\n,;| ]" or s[e].isspace():
                    starts.setdefault(e - size, []).append((e, p))
        first = _SKIP.match(s).end()
        # Of each place where a value may begin: score, begin and end of the value before it, and its text if it isn't that of s.
        best: dict[int, tuple[float, int, int, str | None]] = {first: (0.0, -1, first, None)}
        todo, done, final = [(first, 1)], set(), None

        def reach(i: int, e: int, gain: float, value: str | None) -> None:
            j = _SKIP.match(s, e).end()
            cut = BLANK_CUT if j < n and s[e:j].isspace() and not STRONG.search(s[e:j]) else 0.0
            total = best[i][0] + gain + cut
            if j not in best or total > best[j][0]:
                best[j] = (total, i, e, value)
                heappush(todo, (j, 1))

        # An unknown value may end at every blank up to the next delimiter, end. Its score is linear in its length, so only
        # the best of the begins so far, opened, has to be followed from one blank to the next.
        opened, end = -1, -1
        while todo:
            i, begins = heappop(todo)
            if not begins:
                reach(opened, i, UNKNOWN + UNKNOWN_CHAR * (i - opened), None)
                after = b.end() if (b := _BLANK.match(s, i, end)) else i
                if after < end:
                    heappush(todo, (b.start() if (b := _BLANK.search(s, after, end)) else end, 0))
                else:
                    opened = -1
                continue
            if i in done:
                continue
            done.add(i)
            if i >= n:
                final = i
                break
            for e, p in starts.get(i, ()):
                reach(i, e, p, None)
            if s[i] in "\"'" and (e := self._close(s, i)):
                v = _unquote(s[i:e])
                reach(i, e, self.values.get(v, QUOTED + QUOTED_CHAR * len(v)), v)
            if opened >= 0:
                if best[i][0] - UNKNOWN_CHAR * i > best[opened][0] - UNKNOWN_CHAR * opened:
                    opened = i
                continue
            end = m.start() if (m := STRONG.search(s, i)) else n
            if end == i:
                reach(i, i + 1, 0.0, "")
                continue
            opened = i
            heappush(todo, (b.start() if (b := _BLANK.search(s, i + 1, end)) else end, 0))
        out = []
        while final is not None and final != -1:
            _, before, e, value = best[final]
            if before >= 0 and (value := s[before:e].strip() if value is None else value):
                out.append(value)
            final = before
        return out[::-1]

    @staticmethod
    def _close(s: str, i: int) -> int:
        """The end of the quoted value that begins at i, or 0: the first closing mark before a delimiter, else before a blank."""
        q, j, weak = s[i], i + 1, 0
        while (j := s.find(q, j)) >= 0:
            slashes = 0
            while s[j - 1 - slashes] == "\\" and j - 1 - slashes > i:
                slashes += 1
            if slashes % 2:
                j += 1
            elif q == '"' and s[j + 1 : j + 2] == q:
                j += 2
            elif _AFTER.match(s, j + 1):
                return j + 1
            else:
                if not weak and s[j + 1 : j + 2].isspace():
                    weak = j + 1
                j += 1
        return weak


_COVERS: dict[str, Cover] = {}


def _cover_of(key: str, sent) -> Cover:
    """The automaton of a dictionary that was sent, made once in each Python worker."""
    if key not in _COVERS:
        _COVERS.clear()
        _COVERS[key] = Cover(sent.value)
    return _COVERS[key]


def _stretches(field: str, longest: int) -> set[str]:
    """All parts of a field that Cover may ask its dictionary for, of at most longest characters: from a place where a value
    may begin to one where it may end, and what quote marks enclose.
    """
    s = _strip_list(field)
    n = len(s)
    ends = [i for i in range(1, n + 1) if i == n or s[i] in "\t\r\n,;| ]" or s[i].isspace()]
    begins = sorted({_SKIP.match(s, e).end() for e in [0, *range(1, n + 1)] if e == 0 or e == n or s[e] in "\t\r\n,;|/ ]" or s[e].isspace()})
    marks = [i for i in begins if i < n and s[i] in "\"'"]
    begins = sorted({*begins, *(_SKIP.match(s, e).end() for i in marks if (e := Cover._close(s, i)))})
    out, first = set(), 0
    for i in begins:
        while first < len(ends) and ends[first] <= i:
            first += 1
        for e in ends[first:]:
            if e - i > longest:
                break
            out.add(s[i:e])
    for i in marks:
        if (e := Cover._close(s, i)) and len(v := _unquote(s[i:e])) <= longest:
            out.add(v)
    out.discard("")
    return out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the pieces of each field; quoted: how often the piece stood in quotes."""
    counts: Counter[str] = Counter()

    def flush() -> pa.RecordBatch:
        plain: Counter[str] = Counter()
        quoted: Counter[str] = Counter()
        for piece, c in counts.items():
            t = piece.strip()
            if len(t) > 1 and t[0] == t[-1] and t[0] in "\"'":
                quoted[_unquote(t)] += c
            else:
                plain[t] += c
        counts.clear()
        keys = [k for k in plain.keys() | quoted.keys() if k]
        return pa.RecordBatch.from_pydict(
            {
                "value": pa.array(keys, pa.string()),
                "plain": pa.array([plain[k] for k in keys], pa.int64()),
                "quoted": pa.array([quoted[k] for k in keys], pa.int64()),
            }
        )

    for batch in batches:
        for s in batch.column(0).to_pylist():
            if s:
                counts.update(_PIECE.findall(_strip_list(s)))
        if len(counts) > 100_000:
            yield flush()
    if counts:
        yield flush()


Known = dict[str, float] | DataFrame


def learn_values(df: DataFrame, column: str, min_support: int = 3) -> Known:
    """Known whole values of a packed column with their log probabilities, counted over all rows: a dictionary, or, if it has
    more than SENT_VALUES values or SENT_CHARS characters, a table (value, p).

    A value is known if it stands alone min_support times. A piece that never stood in quotes and that blanks cut into known
    values, each at least as frequent, is a field delimited by blanks and no value. No rows, or only nulls: an empty
    dictionary.
    """
    schema = "value string, plain bigint, quoted bigint"
    counted = df.select(F.col(column).cast("string").alias("v")).where("v is not null").mapInArrow(_pieces, schema)
    counted = counted.groupBy("value").agg((F.sum("plain") + F.sum("quoted")).alias("n"), F.sum("quoted").alias("quoted"))
    counted = cut(counted.where(F.col("n") >= min_support), "pieces")
    size = counted.agg(F.count(F.lit(1)).alias("values"), F.sum(F.length("value")).alias("chars"), F.sum("n").alias("total")).first()
    if size["values"] > SENT_VALUES or (size.chars or 0) > SENT_CHARS:
        return _known_table(counted)
    rows = counted.collect()
    n = {r.value: r.n for r in rows}
    longest = max((len(v.split()) for v in n), default=0)
    kept = {r.value for r in rows if r.quoted or not _composite(r.value, n, longest)}
    return {v: math.log(n[v] / size.total) for v in kept}


def _known_table(counted: DataFrame) -> DataFrame:
    """The same from a table (value, n, quoted): the parts of each value that may be a composite are joined to the table."""
    longest = counted.agg(F.max(F.size(F.split(F.trim("value"), r"\s+")))).first()[0] or 0
    total = counted.agg(F.sum("n")).first()[0] or 1
    doubtful = counted.where((F.col("quoted") == 0) & F.contains("value", F.lit(" "))).select("value", "n")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole, some, n = [], [], []
            for value, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = value.split()
                if len(words) > 1 and " ".join(words) == value:
                    own = {" ".join(words[i:j]) for i in range(len(words)) for j in range(i + 1, min(len(words), i + longest) + 1)} - {value}
                    whole += [value] * len(own)
                    n += [k] * len(own)
                    some += own
            yield pa.RecordBatch.from_arrays([pa.array(whole, pa.string()), pa.array(some, pa.string()), pa.array(n, pa.int64())], ["whole", "value", "least"])

    met = doubtful.mapInArrow(parts, "whole string, value string, least bigint").join(counted.select("value", "n"), "value").where("n >= least")
    found = met.groupBy("whole").agg(F.collect_set("value").alias("parts"))

    def composites(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cut_up = [v for v, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if _composite(v, {v: 1} | dict.fromkeys(own, 1), longest)]
            yield pa.RecordBatch.from_arrays([pa.array(cut_up, pa.string())], ["value"])

    gone = found.mapInArrow(composites, "value string")
    known = counted.join(gone, "value", "left_anti").select("value", F.log(F.col("n") / F.lit(total)).alias("p"))
    return cut(known, "known")


def _composite(value: str, n: dict[str, int], longest: int) -> bool:
    """Whether blanks cut value into values of n, which have at most longest words, each at least as frequent."""
    words = value.split()
    if len(words) < 2 or " ".join(words) != value:
        return False
    ok = [True] + [False] * len(words)
    for j in range(1, len(words) + 1):
        ok[j] = any(
            ok[i] and j - i < len(words) and n.get(" ".join(words[i:j]), -1) >= n[value] for i in range(max(0, j - longest), j)
        )
    return ok[-1]


def with_values(df: DataFrame, column: str, values: Known | None = None, name: str = "values") -> DataFrame:
    """df with the values of a packed column as an array, null for null and without empty values; the column keeps its place."""
    known = learn_values(df, column) if values is None else values
    rest = [F.col(f"`{c}`") for c in df.columns if c != name]
    if isinstance(known, DataFrame):
        rows = df.select(*rest, F.col(column).cast("string").alias("__field"))
        covered = _covered_by_table(rows, known)
        return covered.select(*rest, F.when(F.col("__field").isNotNull(), F.coalesce("__parts", F.array().cast("array<string>"))).alias(name))
    key, sent = uuid.uuid4().hex, df.sparkSession.sparkContext.broadcast(known)

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def parts(fields: pa.Array) -> pa.Array:
        return _split_all(fields.to_pylist(), _cover_of(key, sent).split)

    field = F.col(column).cast("string")
    return df.select(*rest, F.when(field.isNotNull(), parts(field)).alias(name))


def split_packed(
    df: DataFrame,
    column: str,
    values: Known | None = None,
    position: str = "position",
    value: str = "value",
) -> DataFrame:
    """One row per value of a packed column: all columns of df, then the value's position (from 1) and the value.

    values: a dictionary or table of learn_values(); learned from df if none is given. Null, empty and delimiter-only fields
    give no row; a repeated value counts again; a field of any length is read whole. Columns of df called like position or
    value are replaced.
    """
    rest = [c for c in df.columns if c not in (position, value)]
    packed = with_values(df, column, values, "__parts")
    return packed.select(*(F.col(f"`{c}`") for c in rest), F.posexplode("__parts").alias("__at", value)).select(
        *(F.col(f"`{c}`") for c in rest), (F.col("__at") + 1).cast("int").alias(position), value
    )


def _split_all(fields: list[str | None], split: Callable[[str], list[str]]) -> pa.Array:
    flat: list[str] = []
    offsets = [0]
    for s in fields:
        if s:
            flat += split(s)
        offsets.append(len(flat))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.string()))


def _covered_by_table(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows with __parts, the values of __field by a table of known values: each different field is covered once."""
    longest = known.agg(F.max(F.length("value"))).first()[0] or 0
    fields = cut(rows.select("__field").where("__field is not null and __field <> ''").distinct(), "fields")

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for field in b.column(0).to_pylist():
                own = list(_stretches(field, longest))
                yield pa.RecordBatch.from_arrays([pa.array([field] * len(own), pa.string()), pa.array(own, pa.string())], ["__field", "value"])

    met = fields.mapInArrow(stretches, "__field string, value string").join(known, "value")
    own = met.groupBy("__field").agg(F.collect_list(F.struct("value", "p")).alias("__own"))

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some = [Cover({v["value"]: v["p"] for v in held or ()}).split(s) for s, held in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(some, pa.list_(pa.string()))], ["__field", "__parts"])

    covered = cut(fields.join(own, "__field", "left").mapInArrow(cover, "__field string, __parts array<string>"), "covered")
    return join_unique(cut(rows, "rows"), covered, "__field")
