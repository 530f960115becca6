"""Byte-level BPE ids of whole texts, by word memo.

The pattern that splits a text before BPE never joins characters across a
single space between two non-space characters, nor across a single line break
between two non-space characters.  So a text is cut there, each distinct piece
is encoded once per worker (the memo is emptied when it holds `memo` pieces, so
memory is bounded), and the ids are joined.  Texts that hold the special token's
string or rare control spaces go to the tokenizer whole.
"""

from __future__ import annotations

import base64
import re

import numpy as np

_DOUBLE = re.compile(r"\s\s")
_CUT = re.compile(r" (?=\S)")
_ODD = re.compile(r"[\x1c-\x1f]|<\|endoftext\|>")


class _Memo(dict):
    def __init__(self, encode, prefix: str, most: int):
        self.encode, self.prefix, self.most = encode, prefix, most

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        ids = self[word] = np.array(self.encode(self.prefix + word), "<u4").tobytes()
        return ids


class ByteBpe:
    """encode(text) -> little-endian unsigned 32-bit ids as bytes, as `tokenizers` gives for the vocabulary file."""

    def __init__(self, name: str = "byte_bpe_50k", memo: int = 1 << 18):
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(f"{name}.tiktoken"), "rb"))}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.json, self.whole = public_tokenizers.path(f"{name}.json"), None
        self.spaced, self.bare = _Memo(self.fast.encode_ordinary, " ", memo), _Memo(self.fast.encode_ordinary, "", memo // 4)
        self.newline = np.array(self.fast.encode_ordinary("\n"), "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _ODD.search(text):
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.json)
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if _DOUBLE.search(text) or text[0].isspace() or text[-1].isspace():
            first, *rest = _CUT.split(text)
            return (self.bare[first] if first else b"") + b"".join(map(self.spaced.__getitem__, rest))
        out = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            out.append(self.bare[first] + b"".join(map(self.spaced.__getitem__, rest)))
        return self.newline.join(out)


_loaded: dict[str, ByteBpe] = {}


def byte_bpe(name: str = "byte_bpe_50k") -> ByteBpe:
    """One encoder per worker process."""
    if name not in _loaded:
        _loaded[name] = ByteBpe(name)
    return _loaded[name]
