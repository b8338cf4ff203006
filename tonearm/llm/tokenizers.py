"""Public tokenizers from vocabulary files; the path is a parameter and the file's kind follows from its suffix."""

from __future__ import annotations

import base64
import os

import numpy as np

DEFAULT = os.environ.get("TONEARM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")

# Fixed value: the public pattern that cuts text before the merges of byte-level rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_LOADED: dict[str, Tokenizer] = {}


class Tokenizer:
    """Counts tokens of whole texts and tells where they end; no special tokens."""

    def __init__(self, path: str):
        self.kind = path.rsplit(".", 1)[-1]
        if self.kind == "tiktoken":
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
            for token, i in ranks.items():
                self.sizes[i] = len(token)
        elif self.kind == "json":
            from tokenizers import Tokenizer as Fast

            self.encoding = Fast.from_file(path)
            self.encoding.encode_special_tokens = True
        elif self.kind == "model":
            import sentencepiece

            self.encoding = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            raise ValueError(f"no tokenizer for files like {path}")

    def count(self, text: str) -> int:
        if self.kind == "tiktoken":
            return len(self.encoding.encode_ordinary(text))
        if self.kind == "json":
            return len(self.encoding.encode(text, add_special_tokens=False).ids)
        return len(self.encoding.encode(text))

    def ends(self, text: str) -> np.ndarray:
        """The place in characters where each token ends, ascending."""
        if self.kind == "tiktoken":
            ends = np.cumsum(self.sizes[np.array(self.encoding.encode_ordinary(text), np.int64)])
            return ends if text.isascii() else _chars_at(text, ends)
        if self.kind == "json":
            spans = self.encoding.encode(text, add_special_tokens=False).offsets
            return np.maximum.accumulate(np.array([b for _, b in spans], np.int64)) if spans else np.empty(0, np.int64)
        pieces = self.encoding.encode(text, return_type="proto").pieces
        ends = np.maximum.accumulate(np.array([p.end for p in pieces], np.int64)) if pieces else np.empty(0, np.int64)
        return ends if text.isascii() else _chars_at(text, ends)


    @property
    def least_bytes(self) -> int:
        """Bytes a token covers at least, 0 if that can't be told from the file's kind: n tokens need as many bytes."""
        return 1 if self.kind == "tiktoken" else 0


def _chars_at(text: str, byte_ends: np.ndarray) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    return np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[byte_ends]


def load(path: str = DEFAULT) -> Tokenizer:
    """The tokenizer of a file, loaded once in each process."""
    if path not in _LOADED:
        _LOADED[path] = Tokenizer(path)
    return _LOADED[path]
