from __future__ import annotations

import os

import pytest

from tonearm.llm import chunking as ch
from tonearm.llm.tokenizers import DEFAULT, load

HERE = os.path.dirname(DEFAULT)
FILES = [os.path.join(HERE, f) for f in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json", "piece_bpe_32k.model")]

TEXTS = {
    "sections": "\n\n".join(f"# Part {i}\n" + " ".join(f"Sentence {j} of part {i} is here." for j in range(40)) for i in range(12)),
    "paragraphs": "\n\n".join("Words follow words in this paragraph, over and over. " * 6 for _ in range(40)),
    "lines": "\n".join(f"speaker{i}: this is what was said in turn {i}, and no more." for i in range(300)),
    "words": "word " * 3000,
    "marks": ",".join(f"track_{i}" for i in range(2000)),
    "characters": "x" * 9000,
    "japanese": "静かな笛がゆっくり戻る、深い笛を選んだ。" * 300,
    "emoji": "👩‍🚀🚀é" * 1500,
    "accents": "naïve café – “quoted” … " * 500,
}


@pytest.mark.parametrize("path", FILES)
@pytest.mark.parametrize("kind", list(TEXTS))
def test_pieces(kind, path):
    tok, text = load(path), TEXTS[kind]
    pieces = ch.split_text(text, 256, 32, tok)
    assert len(pieces) > 1 and [p[0] for p in pieces] == list(range(len(pieces)))
    assert pieces[0][1] == 0 and pieces[-1][2] == len(text) and pieces[-1][4] == "end"
    for _, a, b, n, _ in pieces:
        assert a < b and tok.count(text[a:b]) == n <= 256
    for (_, a, b, _, at), (_, c, d, _, _) in zip(pieces, pieces[1:]):
        assert a < c <= b < d and tok.count(text[c:b]) <= 32 + ch.SLACK


def test_cuts_are_natural():
    tok = load()
    kinds = lambda k: {p[4] for p in ch.split_text(TEXTS[k], 256, 32, tok)[:-1]}
    assert kinds("paragraphs") == {"paragraph"} and kinds("lines") == {"line"}
    assert kinds("sections") <= {"section", "paragraph", "line", "sentence"} and kinds("words") == {"word"}
    assert kinds("marks") == {"mark"} and kinds("characters") == {"character"}
    text = TEXTS["lines"]
    assert all(text[c - 1] == "\n" for _, c, _, _, _ in ch.split_text(text, 256, 32, tok)[1:])


def test_short_and_bad():
    tok = load()
    assert ch.split_text("", 64, 8, tok) == [(0, 0, 0, 0, "end")]
    assert ch.split_text("a b", 64, 8, tok)[0][2:] == (3, 2, "end")
    exact = "word " * 64
    n = tok.count(exact)
    assert len(ch.split_text(exact, n, 8, tok)) == 1 and len(ch.split_text(exact, n - 1, 8, tok)) == 2
    assert ch.split_text("word " * 500, 64, 0, tok)[1][1] == ch.split_text("word " * 500, 64, 0, tok)[0][2]
    with pytest.raises(ValueError):
        ch.split_text("x", 10, 8, tok)


def test_ends_agree_with_the_text():
    for path in FILES:
        tok = load(path)
        for text in ("plain words here", TEXTS["accents"][:200], "日本語 テキスト", "é👩‍🚀"):
            ends = tok.ends(text)
            assert len(ends) == tok.count(text) and list(ends) == sorted(ends) and ends[-1] == len(text)


def test_operator(spark):
    rows = [(1, TEXTS["lines"]), (2, None), (3, ""), (4, "short"), (4, "short"), (5, "word " * 200_000)]
    df = spark.createDataFrame(rows, "id int, text string").selectExpr("id", "text", "7 as start", "'x' as piece")
    got = ch.split_items(df.drop("start"), "text", 256, 32).collect()
    by = {}
    for r in got:
        by.setdefault(r.id, []).append(r)
    assert 2 not in by and len(by[3]) == 1 and by[3][0].piece_text == "" and len(by[4]) == 2 and by[4][0].n_tokens is None
    text = dict(rows)
    for i in (1, 5):
        assert all(r.piece_text == text[i][r.start : r.stop] for r in by[i]) and len(by[i]) > 5
    arrays = {r.id: r.pieces for r in ch.with_pieces(df, "text", 256, 32).collect()}
    assert arrays[2] is None and len(arrays[1]) == len(by[1])
    none = df.limit(0)
    assert ch.split_items(none.drop("start"), "text").count() == 0
    counts = {r.id: r.n_tokens for r in ch.count_tokens(df, "text").collect()}
    assert counts[2] is None and counts[3] == 0 and counts[4] == load().count("short")
