"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

An Arrow string column already is one byte buffer with offsets, so words are
found by table lookups over the whole buffer and hashed by prefix sums; no
Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

#: True for bytes that belong to words when only white space separates them.
SPACED = np.ones(256, bool)
SPACED[[0x20, 9, 10, 11, 12, 13]] = False
#: True for bytes of words made of digits, lower-case letters and all beyond ASCII.
PLAIN = np.zeros(256, bool)
PLAIN[0x30:0x3A] = PLAIN[0x61:0x7B] = PLAIN[0x80:] = True
#: Lower case for A-Z alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


class Words(NamedTuple):
    start: np.ndarray  # first byte in the block
    end: np.ndarray  # byte after the last
    doc: np.ndarray  # text of the block
    hash: np.ndarray  # 64 bits of the word's bytes


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finisher of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) <= n:
        for k, b in enumerate((BASE, BASE_INVERSE)):
            a = np.full(n + 1, b, np.uint64)
            a[0] = 1
            _powers[k] = np.cumprod(a, dtype=np.uint64)
    return _powers[0][: n + 1], _powers[1][: n + 1]


def forget_powers() -> None:
    """The tables of powers are as long as the largest block so far; the next block makes its own."""
    _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]: off[-1]], off - off[0]


def blocks(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray) -> Words:
    """All words of the texts ``data[offsets[k]:offsets[k + 1]]``, in order."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(z, z, z, np.zeros(0, np.uint64))
    inside = word_bytes[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    up, down = powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = (sums[end] - sums[start]) * down[start]
    return Words(start, end, doc, mix(h ^ ((end - start).astype(np.uint64) << np.uint64(56))))


def windows(w: Words, n_docs: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words within a text.

    Returns the hash, the text and the first word of each. A text of fewer
    words, but not none, gives one run of all its words.
    """
    count = np.bincount(w.doc, minlength=n_docs)
    begin = np.concatenate([[0], np.cumsum(count)])[:-1]
    runs = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    doc = np.repeat(np.arange(n_docs), runs)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(runs) - runs, runs) + begin[doc]
    length = np.minimum(count[doc], size)
    h = np.zeros(len(at), np.uint64)
    for k in range(size):
        ok = length > k
        nxt = w.hash[np.minimum(at + k, len(w.hash) - 1)] if len(w.hash) else np.zeros(0, np.uint64)
        h = np.where(ok, mix(h * BASE + nxt + np.uint64(k + 1)), h)
    return h, doc, at


def starts_of_points(data: np.ndarray) -> np.ndarray:
    """Code points before each byte, and their number at the end."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
