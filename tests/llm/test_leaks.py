from __future__ import annotations

import random

import numpy as np
import pytest

from tonearm.llm import leaks as lk
from tonearm.llm.reading import words


def test_reading():
    for text, want in (
        (None, []),
        ("", []),
        ("Café, naïve!", ["cafe", "naive"]),
        ("ＦＵＬＬ width", ["full", "width"]),
        ("so­ft zero​width jo⁠iner", ["soft", "zerowidth", "joiner"]),
        ("<b>bo</b>ld <i>x</i> a<br/>b &amp; c&nbsp;d&shy;e", ["bold", "x", "a", "b", "c", "de"]),
        ("hyphen-\nated and hyphen-\r\n > > ated half-time", ["hyphenated", "and", "hyphenated", "half", "time"]),
        ("> quoted\n> > twice\n- item *emph* **str**ong", ["quoted", "twice", "item", "emph", "strong"]),
        ("snake_case 3.14 x<y", ["snake", "case", "3", "14", "x", "y"]),
        ("Straße ﬁne", ["strasse", "fine"]),
        ("まつ、りす。", ["まつ", "りす"]),
    ):
        assert words(text) == want, text


def test_winnowing_guarantee():
    rng = random.Random(1)
    for _ in range(200):
        shared = [rng.randrange(1, 50) for _ in range(12)]
        a = np.array([rng.randrange(1, 50) for _ in range(rng.randrange(30))] + shared + [rng.randrange(1, 50) for _ in range(rng.randrange(30))], np.uint64)
        b = np.array([rng.randrange(1, 50) for _ in range(rng.randrange(30))] + shared, np.uint64)
        ha, hb = lk.gram_hashes(a, 8), lk.gram_hashes(b, 8)
        assert set(ha[lk.winnow(ha, 5)]) & set(hb[lk.winnow(hb, 5)])


def _brute(docs, items, t=12):
    out = set()
    grams = {}
    for i, s in items:
        w = words(s)
        for j in range(len(w) - t + 1):
            grams.setdefault(tuple(w[j : j + t]), set()).add(i)
    for d, s in docs:
        w = words(s)
        for j in range(len(w) - t + 1):
            out |= {(d, i) for i in grams.get(tuple(w[j : j + t]), ())}
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    vocab = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(5, 60)))) for i in range(40)]
    items += [(100, items[3][1]), (101, None), (102, ""), (103, " ".join(vocab[:11])), (None, items[3][1])]
    docs = []
    for d in range(300):
        parts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 30)))]
        if d % 3 == 0:
            w = rng.choice(items[:40])[1].split()
            n = rng.randint(8, 16)
            at = rng.randrange(max(1, len(w) - n + 1))
            parts.insert(rng.randint(0, 1), "\n> ".join(w[at : at + n]).upper())
        docs.append((d, " ".join(parts)))
    docs += [(400, None), (401, ""), (402, "word " * 50_000 + items[5][1]), (402, "word " * 50_000 + items[5][1]), (None, items[5][1])]
    return docs, items


def test_finds_every_leak(spark, texts):
    docs, items = texts
    d = spark.createDataFrame(docs, "id bigint, text string").selectExpr("id", "text", "1 as item", "2 as doc")
    i = spark.createDataFrame(items, "id bigint, text string")
    want = _brute([x for x in docs if x[0] is not None], [x for x in items if x[0] is not None])
    got = [(r.doc, r.item) for r in lk.find_leaks(d, i, "id", "text", "id", "text").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 30
    assert {(a, 3) for a, b in want if b == 100} <= want
    some = [(r.doc, r.item) for r in lk.find_leaks(d, i, "id", "text", "id", "text", block_words=200).collect()]
    assert set(some) == want and len(some) == len(want)
    other = {(r.doc, r.item) for r in lk.find_leaks(d, i, "id", "text", "id", "text", min_words=9, k=9).collect()}
    assert other == _brute([x for x in docs if x[0] is not None], [x for x in items if x[0] is not None], 9)


def test_long_items_are_cut_with_overlap(spark, monkeypatch):
    monkeypatch.setattr(lk, "ITEM_WORDS", 40)
    w = [f"x{i}" for i in range(500)]
    items = spark.createDataFrame([(1, " ".join(w))], "id bigint, text string")
    docs = spark.createDataFrame([(a, " ".join(w[a : a + 12])) for a in range(0, 480, 7)] + [(9000, " ".join(w[5:16]))], "id bigint, text string")
    assert {r.doc for r in lk.find_leaks(docs, items, "id", "text", "id", "text").collect()} == set(range(0, 480, 7))


def test_nothing(spark):
    none = spark.createDataFrame([], "id bigint, text string")
    some = spark.createDataFrame([(1, " ".join(map(str, range(30))))], "id bigint, text string")
    assert lk.find_leaks(none, some, "id", "text", "id", "text").count() == 0
    assert lk.find_leaks(some, none, "id", "text", "id", "text").count() == 0
    with pytest.raises(ValueError):
        lk.find_leaks(some, some, "id", "text", "id", "text", min_words=4, k=8)


def test_repeated_words_do_not_multiply():
    one, other = lk.HASHES.of(["spam"]), lk.HASHES.of(["ham", "egg", "tea"])
    items = lk.Items([1, 2, 3, 4], [np.repeat(one, 2000), np.tile(other, 700), np.repeat(one, 11), np.tile(np.concatenate([other, one]), 9)], 8, 12)
    docs = [np.repeat(one, 1_000_000), np.tile(other, 300_000), np.concatenate([other, np.repeat(one, 12)]), np.repeat(one, 11), np.tile(np.concatenate([other, one]), 3)]
    doc, item, n, first = items.hits(docs)
    assert sorted(zip(doc.tolist(), item.tolist())) == [(0, 1), (1, 2), (2, 1), (4, 4)]
    assert dict(zip(doc.tolist(), first.tolist())) == {0: 0, 1: 0, 2: 3, 4: 0} and n.min() > 0 and n[0] > 900_000


def test_periods_against_brute_force(spark):
    rng = random.Random(5)
    texts = []
    for i in range(60):
        unit = [rng.choice("abcd") for _ in range(rng.randint(1, 5))]
        texts.append((i, " ".join((unit * 40)[: rng.randint(8, 60)] + [rng.choice("abcd") for _ in range(rng.randint(0, 20))])))
    df = spark.createDataFrame(texts, "id bigint, text string")
    want = _brute(texts, texts)
    for block in (10**6, 50):
        got = lk.find_leaks(df, df, "id", "text", "id", "text", block_words=block).collect()
        assert {(r.doc, r.item) for r in got} == want and len(got) == len(want)
