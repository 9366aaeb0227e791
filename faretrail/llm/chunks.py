"""Encode texts with a byte-level BPE of the tokenizers library, by cached chunks.

A byte-level pre-tokenizer never joins a non-space to the space after it, so a
text may be cut wherever white space follows something else: the ids of the
text are those of its chunks in order. A full stop or comma after a letter or
digit starts afresh too. The cuts are found by table lookups over the column's
bytes, and Arrow tells the distinct chunks of a group apart, so no Python object
is made for a chunk that repeats in it. Distinct chunks are encoded once and
kept; unknown ones go to the library together, with its own special token
between them, which it never merges with its neighbours.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa

from faretrail.llm import textarrays as ta
from faretrail.llm.common import own_state

#: Where a text may be cut: before these, unless white space stands before them.
BREAK = np.zeros(256, bool)
BREAK[[0x20, 9, 10, 13]] = True
#: Before full stop and comma too, if one of these stands before and nothing or a break follows.
STOP, ALNUM = np.zeros(256, bool), np.zeros(256, bool)
STOP[[0x2C, 0x2E]] = True
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = True
#: White space beyond ASCII, as the number that its last three bytes make (two-byte ones: its last two).
WIDE = np.array([int.from_bytes(c.encode(), "big") for c in "\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))])
CUT = re.compile(rb"(?<=[\x21-\x7e])(?=[ \n\t\r])")
#: Bytes of text that are cut into chunks at a time.
PIECE = 8 << 20
#: Entries after which the cache turns into the old one, which the next turn drops; results do not depend on it.
KEPT = 400_000
#: Chunks that go to the library in one text.
TOGETHER = 128

def encoder(path: str) -> ChunkEncoder:
    """One encoder a process and file, so that tasks of one worker share the cache."""
    held = own_state("chunks")
    if path not in held:
        held[path] = ChunkEncoder(path)
    return held[path]


def chunk_starts(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """First bytes of the chunks of the texts ``raw[off[k]:off[k + 1]]``, in order; an empty text has none."""
    n = len(raw)
    first = np.zeros(n + 1, bool)
    begin, blank = BREAK[raw], ~ta.SPACED[raw]
    first[1:n] = begin[1:] & ~blank[:-1]
    # white space of several bytes does not end a chunk before white space
    if len(at := np.flatnonzero(first[1:n] & (raw[:-1] >= 0x80)) + 1):
        two = raw[at - 1].astype(np.int64) | raw[np.maximum(at - 2, 0)].astype(np.int64) << 8
        three = two | raw[np.maximum(at - 3, 0)].astype(np.int64) << 16
        first[at[np.isin(two, WIDE) | np.isin(three, WIDE)]] = False
    # what follows a full stop: a break, or the next text
    after = np.ones(n + 1, bool)
    after[:n] = begin
    after[off] = True
    first[1:n] |= STOP[raw[1:]] & ALNUM[raw[:-1]] & after[2: n + 1]
    first[off] = True
    return np.flatnonzero(first[:n])


def _spans(raw: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Texts ``i`` to ``j`` of about ``PIECE`` bytes with the bytes they take; those of a longer text in several parts, cut where white space follows something else."""
    for i, j in ta.blocks(off, PIECE):
        at, end = int(off[i]), int(off[j])
        parts = []
        if j == i + 1 and end - at > PIECE:
            text = memoryview(raw[at:end])
            begin = 0
            while len(text) - begin > PIECE and (cut := CUT.search(text, begin + PIECE)):
                parts.append((at + begin, at + cut.start()))
                begin = cut.start()
            at += begin
        yield i, j, [*parts, (at, end)]


class ChunkEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.between, self.between_id = next(iter(added.items()), (None, None))
        size = max([self.tokenizer.get_vocab_size(with_added_tokens=True) - 1, *added.values()])
        self.dtype = np.dtype("<u2") if size < 1 << 16 else np.dtype("<u4")
        self.kept: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _learn(self, chunks: list[str]) -> None:
        mark = self.between
        plain = [c for c in chunks if mark and mark not in c]
        groups = [plain[i: i + TOGETHER] for i in range(0, len(plain), TOGETHER)]
        encoded = self.tokenizer.encode_batch_fast([mark.join(g) for g in groups], add_special_tokens=False) if groups else []
        alone = [c for c in chunks if not mark or mark in c]
        step = self.dtype.itemsize
        for group, e in zip(groups, encoded, strict=True):
            ids = np.array(e.ids, self.dtype)
            cuts = np.flatnonzero(ids == self.between_id)
            if len(cuts) != len(group) - 1:  # a chunk's ends form the special token with the mark
                alone += group
                continue
            raw = ids.tobytes()
            ends = (np.append(cuts, len(ids)) * step).tolist()
            begins = [0, *((cuts + 1) * step).tolist()]
            for c, a, b in zip(group, begins, ends, strict=True):
                self.kept[c] = raw[a:b]
        for c in alone:
            self.kept[c] = self._whole(c)

    def encode(self, text: str | None) -> bytes:
        """The ids of a text (null: of the empty text) as little-endian unsigned integers of ``dtype``."""
        return next(self.encode_many([text]))

    def encode_many(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Encode a column or list of texts in groups of about ``PIECE`` bytes, learning a group's unknown chunks in one go."""
        column = texts if isinstance(texts, (pa.Array, pa.ChunkedArray)) else pa.array(texts, pa.large_string())
        raw, off = ta.utf8(column)
        for i, j, parts in _spans(raw, off):
            if j == i + 1:
                yield b"".join(self._encoded(raw[a:z], np.array([0, z - a]))[0] for a, z in parts)
            else:
                (a, z), = parts
                yield from self._encoded(raw[a:z], off[i: j + 1] - a)

    def _ids(self, chunks: list[str]) -> list[bytes]:
        """The ids of distinct chunks."""
        kept, old = self.kept, self.old
        unknown = list(filterfalse(kept.__contains__, chunks))
        if unknown:
            kept.update({c: old[c] for c in unknown if c in old})
            self._learn(list(filterfalse(old.__contains__, unknown)))
        out = list(map(kept.__getitem__, chunks))
        if len(kept) > KEPT:
            self.kept, self.old = {}, kept
        return out

    def _encoded(self, raw: np.ndarray, off: np.ndarray) -> list[bytes]:
        """The ids of each text of a group."""
        if not len(raw):
            return [b""] * (len(off) - 1)
        starts = chunk_starts(raw, off)
        chunks = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(raw))), pa.py_buffer(raw)).dictionary_encode()
        ids = pa.array(self._ids(chunks.dictionary.to_pylist()), pa.large_binary()).take(chunks.indices)
        _, ends, data = ids.buffers()
        ends = np.frombuffer(ends, np.int64, len(ids) + 1)[np.searchsorted(starts, off)].tolist()
        return [data[a:z].to_pybytes() for a, z in zip(ends, ends[1:])]
