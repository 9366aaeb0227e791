"""Operator 2: benchmark decontamination by an FM-index of each training shard.

A shard is a run of documents of bounded size inside a task. Its words become
symbols (the benchmark's vocabulary; all others are no symbol), and its text is
every stretch of symbols long enough to hold a test phrase, apart by
separators: a phrase can occur nowhere else. Over that text the task builds the
suffix array, the Burrows-Wheeler transform in a wavelet tree, and suffix
positions sampled at every ``SAMPLED``-th place. All phrases are searched
backward at once through the tree's ranks; occurrences are located by walking
to the next sampled position, and their spans are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faretrail.llm import textarrays as ta
from faretrail.llm.common import fresh_name, on_workers, own_state, released

#: Bytes of documents in a shard's index; a longer document is a shard of its own.
SHARD_BYTES = 4 << 20
#: Every so many-th text position keeps its suffix's place.
SAMPLED = 16
#: Bytes of benchmark texts in a block; each block is broadcast and searched by itself.
BLOCK_BYTES = 8 << 20


class Phrases(NamedTuple):
    """Distinct windows of a block of benchmark items."""

    vocabulary: np.ndarray  # sorted word hashes; symbol k + 1 is the k-th
    symbols: np.ndarray  # a row a phrase, padded with 0
    length: np.ndarray
    item_of: np.ndarray  # items of each phrase ...
    item_from: np.ndarray  # ... from here on
    items: list[str | None]


def phrases(items: list[str | None], texts: list[str | None], size: int) -> Phrases:
    data, off = ta.utf8(pa.array(texts, pa.string()))
    w = ta.words(ta.LOWER[data], off, ta.PLAIN)
    vocabulary = np.unique(w.hash)
    symbol = np.searchsorted(vocabulary, w.hash) + 1
    h, doc, at = ta.windows(w, len(texts), size)
    count = np.bincount(w.doc, minlength=len(texts))
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    length = np.minimum(count[doc[first]], size) if len(first) else np.zeros(0, np.int64)
    rows = np.zeros((len(first), size), np.int64)
    for k in range(size):
        ok = length > k
        rows[ok, k] = symbol[at[first][ok] + k]
    pairs = np.unique(np.stack([which.ravel(), doc]), axis=1) if len(doc) else np.zeros((2, 0), np.int64)
    start = np.searchsorted(pairs[0], np.arange(len(first) + 1))
    return Phrases(vocabulary, rows, length, pairs[1], start, items)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order of ``text``, whose last symbol is its only 0; doubles the compared length until no two tie."""
    _, rank = np.unique(text, return_inverse=True)
    rank, n, k = rank.astype(np.int64), len(text), 1
    while True:
        key = rank * (n + 1)
        key[:-k or n] += rank[k:] + 1 if k < n else 0
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank, k = new, 2 * k
        if rank[order[-1]] == n - 1 or k >= 2 * n:
            return order


class WaveletTree:
    """Ranks of symbols in a sequence: a bit level for each bit of the symbols, zeros before ones."""

    def __init__(self, sequence: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.before, self.zeros = [], []
        row = sequence
        for b in range(self.bits - 1, -1, -1):
            bit = (row >> b) & 1
            self.before.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(len(row) - int(bit.sum()))
            row = np.concatenate([row[bit == 0], row[bit == 1]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first ``upto`` of the sequence."""
        low, high = np.zeros_like(upto), upto
        for b, before, zeros in zip(range(self.bits - 1, -1, -1), self.before, self.zeros, strict=True):
            one = ((symbol >> b) & 1).astype(bool)
            l1, h1 = before[low], before[high]
            low = np.where(one, zeros + l1, low - l1)
            high = np.where(one, zeros + h1, high - h1)
        return high - low


class FMIndex:
    def __init__(self, text: np.ndarray):
        """``text``: symbols from 1 on (0 between stretches)."""
        t = np.concatenate([text + 1, [0]])
        n = len(t)
        order = suffix_array(t)
        self.last = t[order - 1]
        self.below = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=int(t.max()) + 2))])
        self.tree = WaveletTree(self.last, int(t.max()))
        kept = order % SAMPLED == 0
        self.kept = np.concatenate([[0], np.cumsum(kept)])
        self.places = order[kept]
        self.top, self.n = int(t.max()), n

    def search(self, p: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """For every phrase the suffixes that it begins, as a range; searched from the last word back."""
        low = np.zeros(len(p.length), np.int64)
        high = np.full(len(p.length), self.n)
        alive = np.arange(len(p.length))
        for k in range(p.symbols.shape[1]):
            alive = alive[(p.length[alive] > k) & (high[alive] > low[alive])]
            if not len(alive):
                break
            symbol = p.symbols[alive, p.length[alive] - 1 - k] + 1
            known = symbol <= self.top
            s = np.where(known, symbol, 0)
            at = self.below[s]
            low[alive] = np.where(known, at + self.tree.rank(s, low[alive]), 0)
            high[alive] = np.where(known, at + self.tree.rank(s, high[alive]), 0)
        return low, high

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text positions of the suffixes in these rows."""
        out, steps = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        todo = np.arange(len(row))
        row = row.copy()
        while len(todo):
            r = row[todo]
            hit = self.kept[r + 1] > self.kept[r]
            done = todo[hit]
            out[done] = self.places[self.kept[row[done]]] + steps[done]
            todo, r = todo[~hit], r[~hit]
            s = self.last[r]
            row[todo] = self.below[s] + self.tree.rank(s, r)
            steps[todo] += 1
        return out


def occurrences(w: ta.Words, p: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(first word, phrase) of every occurrence of a phrase in a shard's words."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(p.length) or not len(w.hash):
        return none
    place = np.minimum(np.searchsorted(p.vocabulary, w.hash), len(p.vocabulary) - 1)
    symbol = np.where(p.vocabulary[place] == w.hash, place + 1, 0)
    known = symbol > 0
    begins = known.copy()
    begins[1:] &= ~known[:-1] | (w.doc[1:] != w.doc[:-1])
    stretch = np.cumsum(begins) - 1
    size = np.bincount(stretch[known], minlength=int(begins.sum()))
    keep = known & (size[np.maximum(stretch, 0)] >= p.length.min()) if len(size) else known
    word = np.flatnonzero(keep)
    if not len(word):
        return none
    # a separator before every stretch but the first
    apart = np.flatnonzero(np.diff(stretch[word]) != 0) + 1
    text = np.insert(symbol[word], apart, 0)
    origin = np.insert(word, apart, -1)
    index = FMIndex(text)
    low, high = index.search(p)
    count = np.maximum(high - low, 0)
    which = np.repeat(np.arange(len(count)), count)
    row = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + low[which]
    return origin[index.locate(row)], which


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 13, text: str = "text",
                  item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Mark in every document the words inside occurrences of benchmark windows.

    Words are runs of digits, letters a-z (A-Z lowered) and characters beyond
    ASCII. A window is ``size`` consecutive words of an item; an item of fewer
    words, but not none, is one window. Adds ``n_words``, ``n_hit`` (words
    inside any occurrence), ``items`` (sorted strings of the item ids with an
    occurring window), ``spans`` (merged stretches of hit words as code points,
    end exclusive) and ``contaminated`` (``n_hit > 0`` and ``20 * n_hit >=
    n_words``). Null texts have no words; an item with a null id marks words but
    is not listed; repeated rows stay; an empty benchmark marks nothing. Columns
    of these names are replaced.

    The benchmark is the stated query set: it is taken in blocks of bounded
    size, each broadcast, and every shard is searched for each block.
    """
    spark = docs.sparkSession
    on_workers(spark)
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("text")).where("text IS NOT NULL").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    n_blocks = int(total // BLOCK_BYTES) + 1
    blocks = []
    for k in range(n_blocks):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == k).orderBy("item", "text").collect()
        blocks.append(spark.sparkContext.broadcast(phrases([r[0] for r in part], [r[1] for r in part], size)))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_state("decontaminate")
        for batch in batches:
            data, off = ta.utf8(batch.column(position))
            parts = [shard(data[off[i]: off[j]], off[i: j + 1] - off[i]) for i, j in ta.blocks(off, SHARD_BYTES)]
            found = pa.concat_tables([pa.table(p) for p in parts]).combine_chunks() if parts else None
            if found is None:
                continue
            columns = [batch.column(k) for k in kept] + [found.column(n).combine_chunks() for n in MADE]
            yield pa.RecordBatch.from_arrays(columns, [batch.schema.field(k).name for k in kept] + list(MADE))
        released()

    def shard(raw: np.ndarray, off: np.ndarray) -> dict[str, pa.Array]:
        n = len(off) - 1
        w = ta.words(ta.LOWER[raw], off, ta.PLAIN)
        change = np.zeros(len(w.hash) + 1, np.int64)
        named: list[set[str]] = [set() for _ in range(n)]
        for b in blocks:
            p = b.value
            first, which = occurrences(w, p)
            np.add.at(change, first, 1)
            np.add.at(change, first + p.length[which], -1)
            pairs = np.unique(np.stack([w.doc[first], which]), axis=1) if len(first) else np.zeros((2, 0), np.int64)
            for d, x in pairs.T.tolist():
                named[d].update(p.items[k] for k in p.item_of[p.item_from[x]: p.item_from[x + 1]].tolist() if p.items[k] is not None)
        hit = np.cumsum(change)[:-1] > 0
        words = np.bincount(w.doc, minlength=n)
        hits = np.bincount(w.doc[hit], minlength=n)
        spans: list[list[dict[str, int]]] = [[] for _ in range(n)]
        if hit.any():
            opens, closes = hit.copy(), hit.copy()
            opens[1:] &= ~hit[:-1] | (w.doc[1:] != w.doc[:-1])
            closes[:-1] &= ~hit[1:] | (w.doc[1:] != w.doc[:-1])
            points = ta.starts_of_points(raw)
            for a, z, d in zip(w.start[opens], w.end[closes], w.doc[opens], strict=True):
                spans[d].append({"start": int(points[a] - points[off[d]]), "end": int(points[z] - points[off[d]])})
        return {"n_words": pa.array(words, pa.int64()), "n_hit": pa.array(hits, pa.int64()),
                "items": pa.array([sorted(x) for x in named], pa.list_(pa.string())),
                "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                "contaminated": pa.array((hits > 0) & (20 * hits >= words), pa.bool_())}

    hidden = fresh_name(docs, "searched")
    given = docs.select(*[c for c in (f"`{c}`" for c in docs.columns) if c.strip("`").lower() not in MADE], F.col(text).alias(hidden))
    position, kept = len(given.columns) - 1, list(range(len(given.columns) - 1))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])
    made = ", ".join(f"{n} {kind}" for n, kind in MADE.items())
    return given.mapInArrow(marked, f"{fields}, {made}" if fields else made)


MADE = {"n_words": "bigint", "n_hit": "bigint", "items": "array<string>",
        "spans": "array<struct<start:bigint,end:bigint>>", "contaminated": "boolean"}
