"""Vectorised word splitting and hashing over a block of texts.

A block of UTF-8 texts is laid end to end and split into words at the ASCII
white space characters; every word gets a 64-bit tabulation hash (a sum of
random table entries picked by the byte and its place in the word).  Two
different words of up to 256 bytes share a hash with probability 2**-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MASK = (1 << 64) - 1
_PLACES = 256


def _table(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**64, (_PLACES, 256), dtype=np.uint64)


_TABLE = _table(7001)
_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the published splitmix64 steps)."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes end to end and the offsets of each text; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if len(texts) == 0 or texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _edges(data: np.ndarray, offsets: np.ndarray, size: int) -> list[int]:
    """Places, about `size` bytes apart, that lie in no word: behind a text or a white space character."""
    out, n = [0], len(data)
    while out[-1] < n:
        end = min(n, out[-1] + size)
        text = int(offsets[np.searchsorted(offsets, end)]) if end < n else n
        while end < text:
            gap = np.flatnonzero(~_WORD[data[end : min(text, end + 4096)]])
            if len(gap):
                text = end + int(gap[0]) + 1
                break
            end += 4096
        out.append(text)
    return out


def _parts(data: np.ndarray, offsets: np.ndarray, size: int):
    """(word starts, word ends, word hashes) of one stretch of bytes after another."""
    edges = _edges(data, offsets, size)
    for a, z in zip(edges, edges[1:]):
        part = data[a:z]
        inside = _WORD[part]
        begins, ends_at = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends_at[:-1] &= ~inside[1:]
        cut = offsets[np.searchsorted(offsets, a, "right") : np.searchsorted(offsets, z)] - a
        begins[cut] = inside[cut]
        ends_at[cut - 1] = inside[cut - 1]
        first, last = np.flatnonzero(begins), np.flatnonzero(ends_at) + 1
        if len(first) == 0:
            continue
        lengths = last - first
        before = np.cumsum(lengths) - lengths
        place = np.arange(int(lengths.sum())) - np.repeat(before, lengths)
        picked = _TABLE.ravel()[(place & (_PLACES - 1)) * 256 + part[inside]]
        yield first + a, last + a, mix(np.add.reduceat(picked, before) + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def words(texts: pa.Array, size: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, word starts, word ends, word hashes, first word of each text and the end).

    Words are maximal runs without ASCII white space; A-Z are lower-cased first.
    Work memory goes with `size`, however long a text is (but a word's bytes are together).
    """
    data, offsets = text_bytes(texts)
    data = _LOWER[data]
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)), *_parts(data, offsets, size)]
    starts, ends, hashes = map(np.concatenate, zip(*parts))
    return data, starts, ends, hashes, np.searchsorted(starts, offsets)


def word_hashes(texts: pa.Array, size: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, first word of each text and the end) alone: the places of words are let go."""
    data, offsets = text_bytes(texts)
    data = _LOWER[data]
    hashes, first, seen, at = [np.zeros(0, np.uint64)], np.zeros(len(offsets), np.int64), 0, 0
    for starts, _, h in _parts(data, offsets, size):
        until = np.searchsorted(offsets, starts[-1], "right")
        first[at:until] = seen + np.searchsorted(starts, offsets[at:until])
        at, seen = until, seen + len(h)
        hashes.append(h)
    first[at:] = seen
    return np.concatenate(hashes), first


def slices(texts: pa.Array, most: int = 4 << 20):
    """Ranges of rows whose texts have about `most` bytes together, so that work memory stays bounded."""
    lengths = np.asarray(pc.binary_length(texts.cast(pa.large_string())).fill_null(0))
    total = np.cumsum(lengths)
    first = 0
    while first < len(lengths):
        base = total[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(total, base + most, side="right")))
        yield first, last
        first = last
