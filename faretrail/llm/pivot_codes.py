"""Operator 11: product-quantisation codes, nearest entries found by fixed pivots.

A vector's integer components are cut into parts; each part position has a
codebook of up to 256 entries that a few rounds of assigning and averaging
improve. The distances of every part to the position's fixed pivots are computed
once and stored with the row. In each round the distances between pivots and
entries then bound every part-entry distance from below by a difference; entries
are evaluated in the order of these bounds and those whose bound exceeds the
best distance so far are left out. Evaluations are exact: integers in double
precision while they fit, Python's integers beyond.

Only codebooks (entries times dimension) pass through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faretrail.llm.common import fresh_name, on_workers, staged

PARTS = 4
ENTRIES = 256
ROUNDS = 4
PIVOTS = 6
#: Rows of one part position that are bounded at a time, and that share one choice of entries.
CHUNK, BLOCK = 2048, 128
#: Entries of least bound that a block evaluates first.
FIRST = 24
#: A block's open pairs are evaluated one by one where they are fewer than one in this many of its open rows and entries.
SPARSE = 8
#: Labels up to which their sums (one row each) are broadcast; more are joined by a shuffle.
BROADCAST_LABELS = 100_000
MAX_LONG = (1 << 63) - 1


def floors(x: np.ndarray) -> np.ndarray:
    """``floor(1024 * x)`` in double precision; exact below 2**53."""
    return np.floor(x.astype(np.float64) * 1024)


def exact_floors(x: np.ndarray) -> list[int]:
    """``floor(1024 * x)`` as Python's integers, for components of any size."""
    return [int(v) * 1024 if abs(v) >= 2.0**53 else int(np.floor(v * 1024)) for v in x.astype(np.float64).tolist()]


def limit(size: int) -> int:
    """Components up to this give squared distances over ``size`` components below 2**53."""
    return int((2.0**51 / size) ** 0.5)


class Codebooks(NamedTuple):
    """The entries as integers, and what bounds and evaluations need of them."""

    entries: list[list[list[int]]]  # by part, entry, position within the part
    exact: bool  # some component is too large for double precision
    values: np.ndarray  # the same as doubles
    squares: np.ndarray  # squared lengths, by part and entry
    near: np.ndarray  # distances to the pivots, by part, entry and pivot

    @staticmethod
    def of(entries: list[list[list[int]]], pivots: np.ndarray) -> Codebooks:
        size = len(entries[0][0])
        exact = max(abs(v) for part in entries for e in part for v in e) > limit(size)
        values = np.array([[[float(v) for v in e] for e in part] for part in entries])
        near = np.stack([distances(values[p], pivots[p]) for p in range(len(entries))])
        return Codebooks(entries, exact, values, (values**2).sum(2), near)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to pivots in single precision."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.sqrt(((x[:, None, :] - pivots[None, :, :]) ** 2).sum(2)).astype(np.float32)


def far_apart(entries: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` entries, each as far as can be from those chosen before; the first entry is the first."""
    chosen = [0]
    least = ((entries - entries[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(entries)):
        chosen.append(int(np.argmax(least)))
        least = np.minimum(least, ((entries - entries[chosen[-1]]) ** 2).sum(1))
    return entries[chosen]


def _closer(who: np.ndarray, best: np.ndarray, rows: np.ndarray, d: np.ndarray, entry: np.ndarray) -> None:
    """Take over the entries that are nearer than those found so far, or as near with a lower index."""
    better = (d < best[rows]) | (d == best[rows]) & (entry < who[rows])
    best[rows[better]], who[rows[better]] = d[better], entry[better]


def nearest(x: np.ndarray, near: np.ndarray, entries: np.ndarray, squares: np.ndarray, entry_near: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each row's nearest entry (ties to the lower index), its squared distance, and how many distances were evaluated."""
    n = len(x)
    who, best, evaluated = np.zeros(n, np.int64), np.full(n, np.inf), 0
    own = (x**2).sum(1)
    for c in range(0, n, CHUNK):
        at = slice(c, min(c + CHUNK, n))
        bound = np.zeros((at.stop - c, len(entries)), np.float32)
        off = np.empty_like(bound)
        for p in range(near.shape[1]):
            np.subtract(near[at, p, None], entry_near[None, :, p], out=off)
            np.maximum(bound, np.abs(off, out=off), out=bound)
        # less what rounding to single precision can add to a difference
        bound -= np.float32(4e-7) * (near[at].max(initial=0) + entry_near.max(initial=0))
        np.maximum(bound, 0, out=bound)
        bound *= bound
        bound *= np.float32(0.99999)
        # rows whose bounds point to one entry share a block
        rows = np.argsort(bound.argmin(1), kind="stable")
        for k in range(0, len(rows), BLOCK):
            low = bound[rows[k: k + BLOCK]]
            here = rows[k: k + BLOCK] + c
            least = low.min(0)
            entry = np.sort(np.argpartition(least, FIRST)[:FIRST]) if len(least) > FIRST else np.arange(len(least))
            live = np.arange(len(here))
            while len(live):
                at_hand = here[live]
                d = own[at_hand, None] - 2 * (x[at_hand] @ entries[entry].T) + squares[entry]
                evaluated += d.size
                j = d.argmin(1)
                _closer(who, best, at_hand, d[np.arange(len(live)), j], entry[j])
                # rows and entries that some bound still leaves open
                low[:, entry] = np.inf
                open_ = low <= best[here, None]
                live, entry = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
                if SPARSE * np.count_nonzero(open_) < len(live) * len(entry):
                    r, e = np.nonzero(open_)
                    d = ((x[here[r]] - entries[e]) ** 2).sum(1)
                    evaluated += len(d)
                    # by row, the least distance with the least entry
                    order = np.lexsort((e, d, r))
                    first = order[np.flatnonzero(np.diff(r[order], prepend=-1))]
                    _closer(who, best, here[r[first]], d[first], e[first])
                    break
    return who, best, evaluated


def assign(vectors: np.ndarray, near: np.ndarray, books: Codebooks) -> tuple[np.ndarray, list[list[int]] | None, np.ndarray | None, np.ndarray]:
    """Codes (rows by parts), the exact vectors of odd rows, which rows these are, and errors (odd ones as objects)."""
    parts, size = books.values.shape[0], books.values.shape[2]
    x = floors(vectors)
    odd = np.flatnonzero(np.abs(x).max(1) > limit(size)) if not books.exact else np.arange(len(x))
    usual = np.setdiff1d(np.arange(len(x)), odd)
    codes, errors = np.zeros((len(x), parts), np.int64), np.zeros(len(x), object)
    for p in range(parts) if len(usual) else ():
        own = np.ascontiguousarray(x[usual, p * size: (p + 1) * size])
        who, d, _ = nearest(own, near[usual, p], books.values[p], books.squares[p], books.near[p])
        codes[usual, p] = who
        errors[usual] += [int(v) for v in d.tolist()]
    whole = []
    for i in odd.tolist():
        whole.append(v := exact_floors(vectors[i]))
        for p in range(parts):
            d, e = min((sum((a - b) ** 2 for a, b in zip(v[p * size: (p + 1) * size], entry, strict=True)), e) for e, entry in enumerate(books.entries[p]))
            codes[i, p] = e
            errors[i] += d
    return codes, whole, odd, errors


def limbs(sums: dict[tuple[int, int], list[int]]) -> Iterator[tuple[int, int, int, list[int]]]:
    """Integers of any size as rows of digits to the base 2**32, so that Spark adds them up in longs."""
    for (part, entry), values in sums.items():
        k = 0
        while any(not -(1 << 31) <= v < 1 << 31 for v in values):
            yield part, entry, k, [v & 0xFFFFFFFF for v in values]
            values, k = [v >> 32 for v in values], k + 1
        yield part, entry, k, values


class Prepared(NamedTuple):
    rows: DataFrame  # id, label, vec, near
    pivots: np.ndarray
    books: Codebooks | None


def vectors_of(column: pa.ListArray, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dim)


def prepared(df: DataFrame, vec_id: str, vector: str, label: str) -> Prepared:
    """Rows to be coded with their pivot distances, the pivots, and the first codebooks (none of an empty table)."""
    kind = df.schema[vector].dataType.elementType
    vec = F.col(vector) if isinstance(kind, (T.FloatType, T.DoubleType)) else F.col(vector).cast("array<double>")
    given = df.select(F.col(vec_id).alias("id"), F.col(label).alias("label"), vec.alias("vec"))
    whole = given.where(F.expr(f"size(vec) > 0 AND size(vec) % {PARTS} = 0 AND forall(vec, x -> x IS NOT NULL AND x != 'NaN' AND abs(x) != 'Infinity')"))
    order = [F.col("id").asc_nulls_last(), "vec"]
    top = whole.orderBy(*order).limit(ENTRIES)
    first = top.collect()
    if not first:
        return Prepared(whole, np.zeros((PARTS, 0, 0)), None)
    dim = len(first[0].vec)
    kept = whole.where(F.size("vec") == dim)
    if any(len(r.vec) != dim for r in first):
        first = kept.orderBy(*order).limit(ENTRIES).collect()
    size = dim // PARTS
    whole_first = [exact_floors(np.array(r.vec)) for r in first]
    entries = [[v[p * size: (p + 1) * size] for v in whole_first] for p in range(PARTS)]
    values = np.array([[[float(v) for v in e] for e in part] for part in entries])
    pivots = np.stack([far_apart(v, PIVOTS) for v in values])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = floors(vectors_of(batch.column(2), dim))
            near = np.concatenate([distances(x[:, p * size: (p + 1) * size], pivots[p]) for p in range(PARTS)], 1)
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * near.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(near.ravel()))], ["id", "label", "vec", "near"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields)
    return Prepared(staged(kept.mapInArrow(measured, f"{kinds}, near array<float>")), pivots, Codebooks.of(entries, pivots))


def _near(batch: pa.RecordBatch, pivots: np.ndarray) -> np.ndarray:
    return np.asarray(batch.column("near").flatten()).reshape(batch.num_rows, PARTS, pivots.shape[1])


def improved(ready: Prepared, books: Codebooks) -> Codebooks:
    """One round: every part to its nearest entry, every used entry to the floor of its parts' mean."""
    dim, size, pivots = books.values.shape[0] * books.values.shape[2], books.values.shape[2], ready.pivots

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = books.values.shape
        sums, counts = np.zeros(shape, np.int64), np.zeros(shape[:2], np.int64)
        large: dict[tuple[int, int], list[int]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = vectors_of(batch.column("vec"), dim)
            codes, whole, odd, _ = assign(vectors, _near(batch, pivots), books)
            x = floors(vectors)
            x[odd] = 0
            for p in range(PARTS):
                counts[p] += np.bincount(codes[:, p], minlength=shape[1])
                for j in range(size):  # the sums of a batch stay below 2**53
                    sums[p, :, j] += np.bincount(codes[:, p], x[:, p * size + j], shape[1]).astype(np.int64)
            for i, v in zip(odd.tolist(), whole, strict=True):
                for p in range(PARTS):
                    had = large.setdefault((p, int(codes[i, p])), [0] * size)
                    large[p, int(codes[i, p])] = [a + b for a, b in zip(had, v[p * size: (p + 1) * size], strict=True)]
        used = {(int(p), int(e)): sums[p, e].tolist() for p, e in np.argwhere(counts)}
        for at, v in large.items():
            used[at] = [a + b for a, b in zip(used[at], v, strict=True)]
        rows = [(p, e, k, int(counts[p, e]) if k == 0 else 0, v) for p, e, k, v in limbs(used)]
        p, e, k, n, v = zip(*rows) if rows else [()] * 5
        yield pa.record_batch({"part": pa.array(p, pa.int32()), "entry": pa.array(e, pa.int32()), "limb": pa.array(k, pa.int32()),
                               "n": pa.array(n, pa.int64()), "sums": pa.array(v, pa.list_(pa.int64()))})

    told = ready.rows.select("vec", "near").mapInArrow(added, "part int, entry int, limb int, n long, sums array<long>")
    total = told.groupBy("part", "entry", "limb").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[j]) for j in range(size)]).alias("sums"))
    found: dict[tuple[int, int], tuple[int, list[int]]] = {}
    for r in total.collect():  # at most the codebooks' size
        n, had = found.get((r.part, r.entry), (0, [0] * size))
        found[r.part, r.entry] = n + r.n, [a + (b << 32 * r.limb) for a, b in zip(had, r.sums, strict=True)]
    entries = [[[v // found[p, e][0] for v in found[p, e][1]] if (p, e) in found else old for e, old in enumerate(part)] for p, part in enumerate(books.entries)]
    return Codebooks.of(entries, pivots)


def codes(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, label, code, error, label_error, codebooks_sha256`` of every row with a whole vector.

    Dropped are rows whose vector is null, holds null or non-finite components,
    has no length that divides into four parts, or another length than that of
    the smallest id. Each component becomes ``floor(1024 * x)``. The first
    codebooks are the parts of the 256 smallest ids (null ids come last, ties by
    the vector; fewer rows give fewer entries); unused entries stay. ``code``
    holds two hex digits a part, ``error`` the squared distances summed over the
    parts, ``label_error`` the errors summed over the rows of equal labels,
    nulls together; what exceeds a long is the largest long.
    ``codebooks_sha256`` is of all final components, comma-joined. Repeated rows
    all stay; an empty table stays empty; other columns are not carried.
    """
    on_workers(df.sparkSession)
    ready = prepared(df, vec_id, vector, label)
    names = {"id": vec_id, "label": label}
    if ready.books is None:
        empty = ready.rows.select("id", "label", *[F.lit(None).cast(t).alias(c) for c, t in (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))])
        return empty.withColumnsRenamed(names)
    books, pivots = ready.books, ready.pivots
    for _ in range(rounds):
        books = improved(ready, books)
    dim = books.values.shape[0] * books.values.shape[2]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found, _, _, errors = assign(vectors_of(batch.column("vec"), dim), _near(batch, pivots), books)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([bytes(r).hex() for r in found.astype(np.uint8)], pa.string()),
                                              pa.array([min(e, MAX_LONG) for e in errors.tolist()], pa.int64())], ["id", "label", "code", "error"])

    kinds = ", ".join(f"{c} {ready.rows.schema[c].dataType.simpleString()}" for c in ("id", "label"))
    out = staged(ready.rows.mapInArrow(coded, f"{kinds}, code string, error long"))
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = staged(out.groupBy(F.col("label").alias("of")).agg(F.least(total, F.lit(MAX_LONG).cast("decimal(38,0)")).cast("long").alias("label_error")))
    if sums.count() <= BROADCAST_LABELS:
        sums = F.broadcast(sums)
    digest = hashlib.sha256(",".join(str(v) for part in books.entries for e in part for v in e).encode()).hexdigest()
    out = out.join(sums, F.col("label").eqNullSafe(F.col("of")), "left").drop("of")
    return out.select("id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")).withColumnsRenamed(names)
