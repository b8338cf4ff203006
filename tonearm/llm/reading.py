"""Texts as a reader sees them: words without letter case, accents, width, punctuation, invisible characters and mark-up."""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np
import xxhash

# HTML elements that stand within a line, so that their tags don't end a word.
_INLINE = (
    "a|abbr|acronym|b|bdi|bdo|big|cite|code|del|dfn|em|font|i|ins|kbd|mark|q|s|samp|small|span|strike|strong|sub|sup|tt|u|var|wbr"
)
_INLINE_TAG = re.compile(rf"</?(?:{_INLINE})(?:\s[^<>]*)?/?>", re.IGNORECASE)
_TAG = re.compile(r"<[a-zA-Z/!?][^<>]*>")
_EMPHASIS = re.compile(r"(\*{1,3}|~~)([^\s*~]+)\1")
_LINE_HYPHEN = re.compile(r"(?<=[^\W_])[-‐‑­][ \t\r]*\n[\W_]*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")


def _strip_table() -> dict[int, None]:
    """Combining marks and format characters of the basic plane, found by their category."""
    return {c: None for c in range(0x10000) if unicodedata.category(chr(c)) in ("Mn", "Me", "Cf")}


_STRIP = _strip_table()


def words(text: str | None) -> list[str]:
    """The words of a text, as runs of letters and digits; none for null.

    Tags of inline elements join what they touch, other tags separate; entities are read; a hyphen at a line's end joins the
    word's parts, whatever prefix of marks the next line has; characters are compatibility-decomposed, stripped of accents and
    invisible characters, and case-folded.
    """
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub("\n", _INLINE_TAG.sub("", text))
    if "&" in text:
        text = html.unescape(text)
    if "*" in text or "~" in text:
        text = _EMPHASIS.sub(r"\2", text)
    if "\n" in text:
        text = _LINE_HYPHEN.sub("", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).translate(_STRIP)
    return _WORD.findall(text.casefold())


class WordHashes(dict):
    """64-bit hashes of words, never 0; kept for words seen before."""

    LIMIT = 1_000_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) or 1
        return h

    def of(self, ws: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))


HASHES = WordHashes()
