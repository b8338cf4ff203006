"""Splitting oversized texts at natural boundaries, with overlap.

A recursive hierarchy of separators - section, paragraph, line, sentence, word, mark, character - cuts a text into units that fit;
consecutive units are packed greedily into pieces up to the limit, and each piece begins with the end of the one before.
Texts that can't exceed the limit by their number of bytes never leave the JVM.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonearm.llm.tokenizers import DEFAULT, Tokenizer, load

#: Ends of units by level; a unit keeps its separator at its end.
LEVELS: list[tuple[str, re.Pattern[str]]] = [
    ("section", re.compile(r"\f|\n(?=[ \t]*(?:#{1,6}[ \t]|\[[^\]\n]{1,40}\][ \t]*\n|<h[1-6]\b|[=*-]{3,}[ \t]*\n))")),
    ("paragraph", re.compile(r"\n[ \t\r]*\n\s*|</p>\s*|<br\s*/?>\s*<br\s*/?>\s*")),
    ("line", re.compile(r"\r\n?|\n| | |<br\s*/?>")),
    ("sentence", re.compile(r"[.!?…]+[\"'’”)\]»]*\s+|[。！？]+[」』）]*\s*")),
    ("word", re.compile(r"\s+|[、，]")),
    ("mark", re.compile(r"[,;|/]+")),
]
CHARACTER = len(LEVELS)
NAMES = [name for name, _ in LEVELS] + ["character"]
#: Tokens kept free in a piece, as a piece cut out of a text may be tokenized in slightly more tokens than inside it.
SLACK = 8

PIECE = T.ArrayType(
    T.StructType(
        [
            T.StructField("piece_no", T.IntegerType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("stop", T.IntegerType()),
            T.StructField("n_tokens", T.IntegerType()),
            T.StructField("boundary", T.StringType()),
        ]
    )
)


class _Text:
    def __init__(self, text: str, tokenizer: Tokenizer):
        self.text, self.tokenizer = text, tokenizer
        self.ends = tokenizer.ends(text)

    def size(self, a: int, b: int) -> int:
        """Tokens that touch characters a to b, as the whole text is tokenized."""
        lo, hi = np.searchsorted(self.ends, (a, b), ("right"))
        whole = hi - lo
        return int(whole + (hi < len(self.ends) and b > (self.ends[hi - 1] if hi else 0)))

    def units(self, a: int, b: int, level: int, most: int, out: list[tuple[int, int, int]]) -> None:
        """Units of at most most tokens that cover a to b, with the level of the boundary at their end."""
        todo = [(a, b, level, max(level - 1, 0))]
        while todo:
            a, b, level, at = todo.pop()
            if self.size(a, b) <= most:
                out.append((a, b, at))
                continue
            if level == CHARACTER:
                lo = int(np.searchsorted(self.ends, a, "right"))
                while a < b:
                    lo += max(1, most - 1)
                    e = min(b, int(self.ends[lo - 1])) if lo <= len(self.ends) else b
                    e = max(e, a + 1)
                    out.append((a, e, CHARACTER if e < b else at))
                    a = e
                continue
            stops = [m.end() for m in LEVELS[level][1].finditer(self.text, a, b) if a < m.end() < b]
            parts = list(zip([a, *stops], [*stops, b]))
            ats = [level] * len(stops) + [at]
            todo += [(x, y, level + 1, z) for (x, y), z in reversed(list(zip(parts, ats)))]

    def overlap_start(self, start: int, stop: int, overlap: int, unit_starts: np.ndarray) -> int:
        """Where the next piece begins: the earliest natural boundary that leaves at most overlap tokens before stop."""
        if overlap <= 0:
            return stop
        hi = int(np.searchsorted(self.ends, stop, "right"))
        first = int(self.ends[hi - overlap - 1]) if hi - overlap - 1 >= 0 else start + 1
        first = max(first, start + 1)
        i = int(np.searchsorted(unit_starts, first))
        if i < len(unit_starts) and unit_starts[i] < stop:
            return int(unit_starts[i])
        for level in range(2, CHARACTER):
            for m in LEVELS[level][1].finditer(self.text, first, stop):
                if m.end() < stop:
                    return m.end()
        return min(first, stop)


def split_text(text: str, limit: int, overlap: int, tokenizer: Tokenizer) -> list[tuple[int, int, int, int, str]]:
    """Pieces (number from 0, start, stop, tokens, kind of boundary at the stop) of a text, in characters.

    A text of at most limit tokens is one piece. Each piece has at most limit tokens, tokenized on its own; pieces cover the
    text, and each begins up to overlap tokens before the end of the one before it.
    """
    if not 0 <= overlap < limit // 2 or limit < 4 * SLACK:
        raise ValueError("limit must be at least 32 tokens, overlap less than half the limit")
    t = _Text(text, tokenizer)
    if len(t.ends) <= limit:
        return [(0, 0, len(text), len(t.ends), "end")]
    room = limit - SLACK
    units: list[tuple[int, int, int]] = []
    t.units(0, len(text), 0, room - overlap, units)
    starts = np.array([u[0] for u in units])
    pieces, i, begin = [], 0, 0
    while i < len(units):
        j = i + 1
        while j < len(units) and t.size(begin, units[j][1]) <= room:
            j += 1
        n = tokenizer.count(text[begin : units[j - 1][1]])
        while n > limit and j > i + 1:
            j -= 1
            n = tokenizer.count(text[begin : units[j - 1][1]])
        if n > limit and begin < units[i][0]:
            begin = units[i][0]
            continue
        if n > limit:
            a, b, at = units[i]
            if b - a == 1:
                raise ValueError(f"one character takes more than {limit} tokens")
            units[i : i + 1] = [(a, (a + b) // 2, CHARACTER), ((a + b) // 2, b, at)]
            starts = np.array([u[0] for u in units])
            continue
        stop = units[j - 1][1]
        pieces.append((len(pieces), begin, stop, n, "end" if j == len(units) else NAMES[units[j - 1][2]]))
        i = j
        begin = t.overlap_start(begin, stop, overlap, starts)
    return pieces


def with_pieces(
    df: DataFrame, text: str, limit: int = 1024, overlap: int = 64, tokenizer: str = DEFAULT, name: str = "pieces", count_short: bool = False
) -> DataFrame:
    """df with an array of pieces (piece_no, start, stop, n_tokens, boundary); start and stop count characters from 0.

    Null texts get null, empty texts one empty piece of no tokens. Texts that are short enough by their bytes needn't be
    tokenized for being cut; without count_short they aren't, and their one piece's n_tokens is null. A column called name is
    replaced.
    """

    @F.arrow_udf(PIECE)
    def cut_up(texts: pa.Array) -> pa.Array:
        tok = load(tokenizer)
        fields = ("piece_no", "start", "stop", "n_tokens", "boundary")
        out = []
        for s in texts:
            out.append([dict(zip(fields, p)) for p in split_text(s.as_py(), limit, overlap, tok)] if s.is_valid else None)
        return pa.array(out, pa.list_(pa.struct([("piece_no", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("n_tokens", pa.int32()), ("boundary", pa.string())])))

    short = 0 if count_short or not load(tokenizer).least_bytes else limit
    long = F.when(F.octet_length(text) > short, F.col(text))
    one = F.array(
        F.struct(
            F.lit(0).alias("piece_no"),
            F.lit(0).alias("start"),
            F.length(text).alias("stop"),
            F.when(F.length(text) == 0, 0).cast("int").alias("n_tokens"),
            F.lit("end").alias("boundary"),
        )
    )
    return df.withColumn(name, F.coalesce(cut_up(long), F.when(F.col(text).isNotNull(), one)))


def split_items(
    df: DataFrame, text: str, limit: int = 1024, overlap: int = 64, tokenizer: str = DEFAULT, piece: str = "piece_text", count_short: bool = False
) -> DataFrame:
    """One row per piece: df's columns without text, then piece_no, start, stop, n_tokens, boundary and the piece's text;
    n_tokens of short texts only with count_short.
    """
    rest = [c for c in df.columns if c not in (text, "__pieces", "__p")]
    cutted = with_pieces(df, text, limit, overlap, tokenizer, "__pieces", count_short).withColumn("__p", F.explode("__pieces"))
    return cutted.select(
        *(F.col(f"`{c}`") for c in rest),
        "__p.*",
        F.substring(F.col(text), F.col("__p.start") + 1, F.col("__p.stop") - F.col("__p.start")).alias(piece),
    )


def count_tokens(df: DataFrame, text: str, tokenizer: str = DEFAULT, name: str = "n_tokens") -> DataFrame:
    """df with the tokens of the whole text (bigint); null for null."""

    @F.arrow_udf(T.LongType())
    def count(texts: pa.Array) -> pa.Array:
        tok = load(tokenizer)
        return pa.array([tok.count(s.as_py()) if s.is_valid else None for s in texts], pa.int64())

    return df.withColumn(name, count(F.col(text)))
