"""Hashed words and word shingles of whole Arrow text columns, with numpy.

A word is a run of bytes other than space and 0x09-0x0D; A-Z count as a-z. The
kernels work on UTF-8 bytes, so texts are never decoded, and on slices of
about a quarter of a megabyte, so memory does not grow with the batch. A text longer than
that is a slice of its own and is still handled whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18
SHINGLE_WORDS = 5

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int = 0) -> np.ndarray:
    """``n`` odd 64-bit multipliers, the same in every process."""
    start = np.uint64((salt * 0xD1B54A32D192ED03) % 2**64)
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + start) | np.uint64(1)


_BYTE = seeds(256)
_BYTE[65:91] = _BYTE[97:123]
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(which: str, n: int) -> np.ndarray:
    if len(_powers[which]) < n:
        step = _BASE if which == "up" else pow(_BASE, -1, 2**64)
        row = np.full(n, step, np.uint64)
        row[0] = 1
        _powers[which] = np.cumprod(row)
    return _powers[which][:n]


class Words(NamedTuple):
    """Word ``i`` spans bytes ``start[i]:end[i]`` of the slice; text ``t`` has words ``first[t]:first[t + 1]``."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    offsets: np.ndarray


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array without nulls, and the ``n + 1`` offsets of its texts."""
    wide = pa.types.is_large_string(texts.type)
    bounds = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]] if data is not None and bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    return raw, bounds.astype(np.int64) - int(bounds[0])


def slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive parts of a text column of at most ``SLICE_BYTES``, or one text; nulls become empty."""
    texts = pc.fill_null(texts, "")
    if not len(texts):
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        taken = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, taken + SLICE_BYTES, "right")))
        yield at, texts.slice(at, to - at)
        at = to


def words(texts: pa.Array) -> Words:
    """Hashed words of a slice: a polynomial of its bytes from prefix sums modulo 2**64, then mixed."""
    data, offsets = text_bytes(texts)
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, np.zeros(len(texts) + 1, np.int64), offsets)
    inside = ~_SPACE[data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < n)]
    begins[edges] |= inside[edges]
    stops[edges - 1] |= inside[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return Words(span_hashes(data, start, end), start, end, np.searchsorted(start, offsets), offsets)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte spans, equal to those of words with the same bytes."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power("down", max(len(data), 1))[:len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * _power("up", len(data) + 1)[start])


_PLACE = seeds(64, 5)


def windows(hashed: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive words, by place of the first one."""
    n = len(hashed) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = hashed[:n] * _PLACE[0]
    for j in range(1, width):
        total += hashed[j:n + j] * _PLACE[j]
    return mix(total)


def shingle_sets(texts: pa.Array, width: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every text of a slice.

    A text of fewer than ``width`` words has its whole sequence as its one
    shingle; a text without words has none.
    """
    w = words(texts)
    rows = windows(w.hash, width)
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= width:
            yield np.unique(rows[a:b - width + 1])
        else:
            yield windows(w.hash[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's ``long``."""
    return x.astype(np.uint64).view(np.int64)
