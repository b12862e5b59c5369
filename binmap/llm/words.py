"""Vectorised words and word hashes of Arrow text batches.

A word is a maximal run of bytes other than the six ASCII white-space characters; A-Z count as a-z.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text makes a piece of its own.
PIECE = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


_LETTER = mix(_FOLD.astype(np.uint64) + np.uint64(1))


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    with np.errstate(over="ignore"):
        up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up), np.cumprod(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > 2 * PIECE:
        return _powers.__wrapped__(n)
    size = 2 * PIECE
    up, down = _powers(size)
    return up[:n], down[:n]


def pieces(texts: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most limit bytes each, or of one row."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield start, stop
        start = stop


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins (nulls are empty); one more offset ends the last."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each text where its words begin (one more ends the last)."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    first, last = np.empty_like(solid), np.empty_like(solid)
    first[0], first[1:] = True, ~solid[:-1]
    last[-1], last[:-1] = True, ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = True
    last[inner - 1] = True
    starts = np.flatnonzero(solid & first)
    ends = np.flatnonzero(solid & last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, from prefix sums of a polynomial in the span's bytes."""
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = powers(len(data))
    with np.errstate(over="ignore"):
        sums = np.cumsum(_LETTER[data] * up)
        h = sums[ends - 1]
        h -= np.where(starts > 0, sums[starts - 1], np.uint64(0))
        return mix(h * down[starts] + (ends - starts).astype(np.uint64))


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of every k consecutive words of a text (of all its words, if it has fewer), the text's number and the first word's index."""
    counts = np.diff(first)
    made = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(counts)), made)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(made) - made, made) + first[:-1][doc]
    short = np.repeat(counts < k, made)
    with np.errstate(over="ignore"):
        h = np.zeros(len(doc), np.uint64)
        for i in range(k):
            if short.any():
                there = ~short | (i < counts[doc])
                w = np.where(there, words[np.minimum(at + i, len(words) - 1)], np.uint64(0))
            else:
                w = words[at + i]
            h = (h ^ w) * _BASE + np.uint64(i + 1)
    return mix(h), doc, at
