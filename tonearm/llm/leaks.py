"""Evaluation texts leaking into training text, by winnowing.

Of every window of consecutive k-gram hashes the smallest is kept as a fingerprint, in the items and in the documents.
With min_words = k + window - 1, any shared run of min_words words holds a whole window, in which both sides keep the same
fingerprint, so no such run is missed. Matching fingerprints are extended word by word; runs of min_words words count.

The items are a stated query set: up to a fixed number of words they are held as sorted arrays of fingerprints and word
hashes, which meet all documents in one scan without a shuffle. Beyond it the fingerprints of both sides are joined, and of
the documents' only those that a Bloom filter lets pass. Either way the documents are read once. Fingerprints that stand in
equal surroundings in one text match alike and are compared once, so that repeated words don't multiply.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.llm.overlap import _may_hold, bloom
from tonearm.llm.reading import HASHES, words
from tonearm.storage import cut

BLOCK_WORDS = 2_000_000
ITEM_WORDS = 100_000
SLICE = 1 << 16
_B = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def gram_hashes(w: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive word hashes."""
    n = len(w) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            h = h * _B + w[i : i + n]
        h ^= h >> np.uint64(32)
        h *= _MIX
        h ^= h >> np.uint64(29)
    return h


def winnow(h: np.ndarray, window: int) -> np.ndarray:
    """Positions whose hash is the smallest of some window of consecutive hashes; all positions of fewer than window."""
    n = len(h) - window + 1
    if n <= 0:
        return np.arange(len(h))
    least = h[:n].copy()
    for i in range(1, window):
        np.minimum(least, h[i : i + n], out=least)
    keep = np.zeros(len(h), bool)
    for i in range(window):
        keep[i : i + n] |= h[i : i + n] == least
    return np.flatnonzero(keep)


def _around(text: np.ndarray, p: np.ndarray, k: int, t: int) -> np.ndarray:
    """The words around each fingerprint: t before it, its own k, and t after it. text is padded with t words at both ends."""
    return text[p[:, None] + np.arange(-t, k + t)[None]]


def _digest(text: np.ndarray, p: np.ndarray, k: int, t: int) -> np.ndarray:
    """A 64-bit hash of the words around each fingerprint."""
    h = np.zeros(len(p), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(-t, k + t):
            h = (h ^ (h >> np.uint64(31))) * _B + text[p + i]
        return (h ^ (h >> np.uint64(32))) * _MIX


def _runs(a: np.ndarray, b: np.ndarray, k: int, t: int) -> tuple[np.ndarray, np.ndarray]:
    """(words of the run before the fingerprint, words of the run) of paired surroundings; 0 words if the fingerprints differ."""
    same = a == b
    left = np.logical_and.accumulate(same[:, t - 1 :: -1], axis=1).sum(1)
    right = np.logical_and.accumulate(same[:, t + k :], axis=1).sum(1)
    return left, np.where(same[:, t : t + k].all(1), left + k + right, 0)


class Prints:
    """Fingerprints of texts, one of those that stand in equal surroundings in one text, which match alike."""

    def __init__(self, texts: list[np.ndarray], k: int, min_words: int, filler: int, keep=None):
        t = min_words
        pad = np.full(t, filler, np.uint64)
        parts, starts, at = [pad], [], t
        for w in texts:
            starts.append(at)
            parts += [w, pad]
            at += len(w) + t
        self.words = np.concatenate(parts)
        h = gram_hashes(self.words, k)
        p = winnow(h, t - k + 1)
        if keep is not None:
            p = p[keep(h[p])]
        begins = np.array([*starts, at], np.int64)
        owner = np.searchsorted(begins, p, "right") - 1
        inside = (owner >= 0) & (p + k <= begins[np.minimum(owner + 1, len(texts))] - t)
        p, owner = p[inside], owner[inside]
        context = _digest(self.words, p, k, t)
        with np.errstate(over="ignore"):
            _, first, counts = np.unique(context ^ (owner.astype(np.uint64) * _MIX), return_index=True, return_counts=True)
        self.place, self.owner, self.count = p[first], owner[first], counts
        self.hash = h[self.place]
        self.start = self.place - begins[self.owner]


class Items:
    """Fingerprints of a block of items, sorted, with the words around them."""

    def __init__(self, ids: list[int], texts: list[np.ndarray], k: int, min_words: int):
        self.k, self.min_words = k, min_words
        self.ids = np.array(ids, np.int64)
        found = Prints(texts, k, min_words, np.iinfo(np.uint64).max)
        order = np.argsort(found.hash, kind="stable")
        self.words, self.prints = found.words, found.hash[order]
        self.places, self.owners = found.place[order], found.owner[order]

    def known(self, h: np.ndarray) -> np.ndarray:
        """Whether each hash is a fingerprint of some item."""
        if not len(self.prints):
            return np.zeros(len(h), bool)
        return self.prints[np.minimum(np.searchsorted(self.prints, h), len(self.prints) - 1)] == h

    def hits(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document index, item id, fingerprints of the document on shared runs, first word of the first run) of the documents
        and items that share a run of min_words words. Pairs of fingerprints are compared in slices of bounded size.
        """
        t, k = self.min_words, self.k
        d = Prints(docs, k, t, 0, self.known)
        lo = np.searchsorted(self.prints, d.hash, "left")
        n = np.searchsorted(self.prints, d.hash, "right") - lo
        upto = np.cumsum(n)
        found: dict[tuple[int, int], int] = {}
        for a in range(0, int(upto[-1]) if len(upto) else 0, SLICE):
            flat = np.arange(a, min(a + SLICE, int(upto[-1])))
            i = np.searchsorted(upto, flat, "right")
            entry = lo[i] + flat - (upto[i] - n[i])
            left, run = _runs(_around(d.words, d.place[i], k, t), _around(self.words, self.places[entry], k, t), k, t)
            good = np.flatnonzero(run >= t)
            for x, o, at in zip(i[good].tolist(), self.owners[entry[good]].tolist(), (d.start[i[good]] - left[good]).tolist()):
                if at < found.get((x, o), at + 1):
                    found[x, o] = at
        pairs: dict[tuple[int, int], list[int]] = {}
        for (x, o), at in found.items():
            held = pairs.setdefault((int(d.owner[x]), int(self.ids[o])), [0, at])
            held[0] += int(d.count[x])
            held[1] = min(held[1], at)
        keys = list(pairs)
        column = lambda values: np.array(values, np.int64)
        return column([x for x, _ in keys]), column([o for _, o in keys]), column([pairs[x][0] for x in keys]), column([pairs[x][1] for x in keys])


def _item_rows(min_words: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = ITEM_WORDS - min_words + 1
        for b in batches:
            ids, parts = [], []
            for i, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = HASHES.of(words(s))
                for a in range(0, max(1, len(w) - min_words + 1), step):
                    if len(part := w[a : a + ITEM_WORDS]) >= min_words:
                        ids.append(i)
                        parts.append(part.view(np.int64))
            yield pa.RecordBatch.from_pydict(
                {"item": pa.array(ids, pa.int64()), "w": pa.array(parts, pa.list_(pa.int64())), "n": pa.array(map(len, parts), pa.int64())}
            )

    return rows


_HIT_NAMES = ["doc", "item", "n_hits", "first_word"]
_HIT = "doc bigint, item bigint, n_hits bigint, first_word bigint"
_HELD: dict[str, Items] = {}


def _doc_hits(key: str, block, k: int, min_words: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _HELD:
            _HELD.clear()
            _HELD[key] = Items(*block.value, k, min_words)
        for ids, texts in _batched(batches):
            doc, item, n, first = _HELD[key].hits(texts)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[doc]), pa.array(item), pa.array(n), pa.array(first)], _HIT_NAMES)

    return rows


def _batched(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Ids and words of the texts of batches, about a million words at a time; null ids and texts are left out."""
    ids, texts, size = [], [], 0
    for b in batches:
        for i, s in zip(b.column(0), b.column(1)):
            if i.is_valid and s.is_valid:
                w = HASHES.of(words(s.as_py()))
                ids.append(i.as_py())
                texts.append(w)
                size += len(w)
                if size > 1_000_000:
                    yield ids, texts
                    ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _joined(source: DataFrame, hashed: DataFrame, k: int, t: int) -> DataFrame:
    """The hits of items too many to be sent: fingerprints of both sides, with the words around them, meet in a join.

    The documents are read once; of their fingerprints only those that a Bloom filter of the items' lets pass are shuffled.
    """

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_pylist(), [x.values.to_numpy().view(np.uint64) for x in b.column(1)]
            if not ids:
                continue
            f = Prints(texts, k, t, np.iinfo(np.uint64).max)
            around = [x.tobytes() for x in _around(f.words, f.place, k, t)] if len(f.place) else []
            yield pa.RecordBatch.from_arrays([pa.array(f.hash.view(np.int64)), pa.array(np.array(ids, np.int64)[f.owner]), pa.array(around, pa.binary())], ["print", "item", "wa"])

    entries = cut(hashed.select("item", "w").mapInArrow(of_items, "print bigint, item bigint, wa binary"), "prints")
    sent = source.sparkSession.sparkContext.broadcast(bloom(entries.select("print"), entries.count()))

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _batched(batches):
            f = Prints(texts, k, t, 0, lambda h: _may_hold(sent.value, h))
            around = [x.tobytes() for x in _around(f.words, f.place, k, t)] if len(f.place) else []
            own = pa.array(np.array(ids, np.int64)[f.owner] if len(f.owner) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(f.hash.view(np.int64)), own, pa.array(f.start.astype(np.int64)), pa.array(f.count.astype(np.int64)), pa.array(around, pa.binary())],
                ["print", "doc", "at", "n", "wd"],
            )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                a, z = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint64).reshape(part.num_rows, -1) for c in ("wd", "wa"))
                left, run = _runs(a, z, k, t)
                good = np.flatnonzero(run >= t)
                held = part.take(pa.array(good))
                first = held.column("at").to_numpy() - left[good]
                yield pa.RecordBatch.from_arrays([held.column("doc"), held.column("item"), held.column("at"), held.column("n"), pa.array(first)], ["doc", "item", "at", "n", "first"])

    prints = source.mapInArrow(of_docs, "print bigint, doc bigint, at bigint, n bigint, wd binary")
    met = prints.join(entries, "print").select("doc", "item", "at", "n", "wd", "wa")
    runs = met.mapInArrow(verify, "doc bigint, item bigint, at bigint, n bigint, first bigint")
    runs = runs.groupBy("doc", "item", "at").agg(F.max("n").alias("n_hits"), F.min("first").alias("first_word"))
    return runs.select("doc", "item", "n_hits", "first_word")


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str,
    doc_text: str,
    item_id: str,
    item_text: str,
    min_words: int = 12,
    k: int = 8,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(doc, item, n_hits, first_word) for every document and item that share min_words consecutive words.

    n_hits: the document's fingerprints on shared runs; first_word: the first run's word position in the document. Ids are
    bigint. Null ids and null or empty texts give no row; items of fewer than min_words words can't leak; repeated rows of
    either side count once for the pair, only n_hits tells; texts of any length are read whole, and repeated words in them
    cost no more than others. Copies of an item are compared once and expanded at the end. Items of up to block_words words
    in all are sent to the documents; fingerprints of more meet those of the documents in a join, with the same result.
    """
    if not 0 < k <= min_words:
        raise ValueError("k must be between 1 and min_words")
    spark = docs.sparkSession
    texts = items.select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).alias("s")).where("i is not null and s is not null")
    texts = texts.withColumn("c", F.md5("s"))
    owners = texts.groupBy("c", "i").count().drop("count")
    first = owners.groupBy("c").agg(F.min("i").alias("item"))
    owners = owners.join(first, "c").select("item", F.col("i").alias("owner"))
    unique = texts.groupBy("c").agg(F.min("i").alias("i"), F.min("s").alias("s")).select("i", "s")
    hashed = cut(unique.mapInArrow(_item_rows(min_words), "item bigint, w array<bigint>, n bigint"), "items")
    total = hashed.agg(F.sum("n")).first()[0] or 0
    source = docs.select(F.col(doc_id).cast("bigint").alias("d"), F.col(doc_text).alias("s"))
    if total > block_words:
        out = _joined(source, hashed, k, min_words)
    else:
        rows = hashed.select("item", "w").orderBy("item").collect()
        held = ([r.item for r in rows], [np.array(r.w, np.int64).view(np.uint64) for r in rows])
        out = source.mapInArrow(_doc_hits(uuid.uuid4().hex, spark.sparkContext.broadcast(held), k, min_words), _HIT)
    pairs = out.groupBy("doc", "item").agg(F.sum("n_hits").alias("n_hits"), F.min("first_word").alias("first_word"))
    return pairs.join(owners, "item").select("doc", F.col("owner").alias("item"), "n_hits", "first_word")
