"""Operator 10: n-gram Jaccard join with set-relation skipping.

Exact components of the graph that links texts whose sets of word shingles have
a Jaccard similarity of at least 3/4.

1. A set is a class of texts (its fingerprint); each batch of documents sends
   its sets' shingles, as packed blocks by hash range, to the range's task, which
   keeps those that occur in more than one set and counts them. A set with less
   than 3/4 of its shingles shared has no partner and drops out here.
2. The others are indexed under their rarest shingles: of n shingles the first
   n - ceil(3n/4) + 1, rarest first, of which those of no other set need no list.
   A list's entries know their position and their set's size.
3. Set relations: a list's most central set answers for the sets that are
   similar to it, which take over its component. Only pairs of different
   components are still looked at: lists are joined block by block, by size and
   position, and blocks that cannot hold a link are skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faretrail.llm import textarrays as ta
from faretrail.llm.common import components, on_workers, own_state, released, staged

SHINGLE = 5
#: Texts and bytes of a batch whose sets are packed together.
BATCH_DOCS, BATCH_BYTES = 16_384, 16 << 20
#: Shingles of a hash range, and the fewest ranges as a power of two.
RANGE_SHINGLES, LEAST_RANGES = 1 << 20, 10
MORE = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(column, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes (sorted within a text), their texts, the sets' sizes and fingerprints."""
    raw, off = ta.utf8(column)
    n = len(off) - 1
    h, d = [], []
    for i, j in ta.blocks(off, 2 << 20):
        w = ta.words(ta.LOWER[raw[off[i]: off[j]]], off[i: j + 1] - off[i], ta.SPACED)
        hashes, doc, _ = ta.windows(w, j - i, size)
        order = np.lexsort((hashes, doc))
        hashes, doc = hashes[order], doc[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
        h.append(hashes[new])
        d.append(doc[new] + i)
    h, d = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((h, np.uint64), (d, np.int64)))
    sizes = np.bincount(d, minlength=n)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(ta.mix(h ^ MORE), dtype=np.uint64)])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    prints = ta.mix(sums[ends[1:]] - sums[ends[:-1]] + sizes.astype(np.uint64) * ta.BASE).view(np.int64)
    return h, d, sizes, prints


def _batches(column) -> Iterator[tuple[int, int]]:
    _, off = ta.utf8(column)
    for i, j in ta.blocks(off, BATCH_BYTES):
        for k in range(i, j, BATCH_DOCS):
            yield k, min(k + BATCH_DOCS, j)


def _batch_key(prints: np.ndarray) -> int:
    """A batch's name, made from what it holds: batches with one name hold the same sets in the same places."""
    return int(ta.mix(np.cumsum(ta.mix(prints.view(np.uint64) + np.arange(len(prints), dtype=np.uint64)), dtype=np.uint64)[-1:]).view(np.int64)[0])


def _sets(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """``(doc_id, n, print)`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_state("jaccard")
        for batch in batches:
            for i, j in _batches(batch.column(1)):
                _, _, sizes, prints = shingle_sets(batch.column(1).slice(i, j - i))
                yield pa.record_batch({"doc_id": batch.column(0).slice(i, j - i), "n": pa.array(sizes, pa.int64()), "print": pa.array(prints)})
        released()

    return docs.select(F.col(doc).cast("long"), F.col(text)).mapInArrow(run, "doc_id long, n long, print long")


def _ranges(docs: DataFrame, text: str, bits: int) -> DataFrame:
    """``(range, batch, tokens, places, counts)``: a batch's shingles of one range of hashes, packed.

    A batch's sets go with them, from the same pass, as one row of a negative
    range: its tokens are the sets' fingerprints, its counts their sizes, both
    by place. So the places hold however Arrow cuts the rows into batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in _batches(batch.column(0)):
                h, d, sizes, prints = shingle_sets(batch.column(0).slice(i, j - i))
                first = np.zeros(j - i, bool)
                first[np.unique(prints, return_index=True)[1]] = True
                h, d = h[first[d]], d[first[d]]
                if not len(h):
                    continue
                where = h >> np.uint64(64 - bits)
                order = np.argsort(where, kind="stable")
                token = ((h[order] >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype("<u4")
                place = d[order].astype("<u2")
                names, at = np.unique(where[order], return_index=True)
                ends = np.append(at[1:], len(order))
                key = _batch_key(prints)
                sets = -1 - (key & ((1 << bits) - 1))
                yield pa.record_batch({"range": pa.array([sets, *names.tolist()], pa.int32()), "batch": pa.array(np.full(len(names) + 1, key)),
                                       "tokens": pa.array([prints.astype("<i8").tobytes(), *[token[a:b].tobytes() for a, b in zip(at, ends, strict=True)]], pa.binary()),
                                       "places": pa.array([b"", *[place[a:b].tobytes() for a, b in zip(at, ends, strict=True)]], pa.binary()),
                                       "counts": pa.array([sizes.astype("<i8").tobytes(), *[None] * len(names)], pa.binary())})
        released()

    return docs.select(text).mapInArrow(run, "range int, batch long, tokens binary, places binary, counts binary")


def _shared(table: pa.Table) -> pa.Table:
    """Of one range the tokens of more than one set, with their counts, back by batch; rows of sets as they are."""
    if table.column("range")[0].as_py() < 0:
        return table
    parts = [np.frombuffer(x.as_py(), "<u4") for x in table.column("tokens")]
    flat = np.concatenate(parts)
    _, which, times = np.unique(flat, return_inverse=True, return_counts=True)
    count = times[which.ravel()]
    out: dict[str, list] = {"range": [], "batch": [], "tokens": [], "places": [], "counts": []}
    at = 0
    for part, batch, places in zip(parts, table.column("batch").to_pylist(), table.column("places").to_pylist(), strict=True):
        c = count[at: at + len(part)]
        at += len(part)
        keep = c > 1
        if keep.any():
            out["range"].append(table.column("range")[0].as_py())
            out["batch"].append(batch)
            out["tokens"].append(part[keep].tobytes())
            out["places"].append(np.frombuffer(places, "<u2")[keep].tobytes())
            out["counts"].append(np.minimum(c[keep], 0xFFFFFFFF).astype("<u4").tobytes())
    return pa.table(out, pa.schema([("range", pa.int32()), ("batch", pa.int64()), ("tokens", pa.binary()), ("places", pa.binary()), ("counts", pa.binary())]))


def least_overlap(n):
    """The fewest common elements that a set of n shares with any partner: ceil(3n/4)."""
    return -(-3 * n // 4)


def _survivors(table: pa.Table) -> pa.Table:
    """Of one batch the sets with enough shared tokens: their tokens, their index prefix, their centrality."""
    own = np.array([r < 0 for r in table.column("range").to_pylist()])
    if not own.any():
        raise ValueError("a batch has shared tokens but no sets")
    # equal batches have one name and hold the same sets
    sets, shared = table.filter(pa.array(own)).slice(0, 1), table.filter(pa.array(~own))
    schema = pa.schema([("print", pa.int64()), ("n", pa.int64()), ("central", pa.int64()), ("tokens", pa.binary()),
                        ("prefix", pa.list_(pa.int64())), ("skipped", pa.int32())])
    out: dict[str, list] = {k: [] for k in schema.names}
    if shared.num_rows:
        ranges = shared.column("range").to_numpy().astype(np.int64)
        cols = [[np.frombuffer(x.as_py(), t) for x in shared.column(c)] for c, t in (("tokens", "<u4"), ("places", "<u2"), ("counts", "<u4"))]
        token = np.concatenate([r << 32 | x.astype(np.int64) for r, x in zip(ranges, cols[0], strict=True)])
        place, count = np.concatenate(cols[1]).astype(np.int64), np.concatenate(cols[2]).astype(np.int64)
        order = np.lexsort((token, count, place))
        token, place, count = token[order], place[order], count[order]
        print_of, n_of = (np.frombuffer(sets.column(c)[0].as_py(), "<i8") for c in ("tokens", "counts"))
        found, at = np.unique(place, return_index=True)
        for p, a, b in zip(found.tolist(), at.tolist(), [*at[1:].tolist(), len(place)], strict=True):
            n, mine = int(n_of[p]), np.unique(token[a:b]).size
            if mine < least_overlap(n):
                continue
            alone = n - (b - a)
            out["print"].append(int(print_of[p]))
            out["n"].append(n)
            out["central"].append(int((count[a:b].sum() + alone) * 1000 // n))
            out["tokens"].append(np.sort(token[a:b]).tobytes())
            out["prefix"].append(token[a:b][: max(n - least_overlap(n) + 1 - alone, 0)])
            out["skipped"].append(alone)
    return pa.table(out, schema)


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose sets have a similarity of at least 3/4."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column("n").to_numpy(), batch.column("m").to_numpy()
            keep = []
            for k in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[k].as_buffer(), "<i8") for c in ("tokens", "others"))
                both = len(np.intersect1d(x, y, assume_unique=False))
                keep.append(100 * both >= 75 * (n[k] + m[k] - both))
            yield pa.record_batch({c: batch.column(c) for c in ("a", "b")}).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("print").alias("a"), "n", "tokens")
    right = sets.select(F.col("print").alias("b"), F.col("n").alias("m"), F.col("tokens").alias("others"))
    rows = pairs.select("a", "b").distinct().join(left, "a").join(right, "b").select("a", "b", "n", "m", "tokens", "others")
    return rows.mapInArrow(run, "a long, b long")


def _fits(a: str, b: str) -> str:
    """Can entries a and b be the first common element of a link?

    Their sizes must fit, and as no common element stands before the first one,
    enough must be left from both positions on: a link takes 3/7 of both sizes.
    """
    x, y = ({k: name.format(k) for k in ("n", "at")} for name in (a, b))
    left = f"least({x['n']} - {x['at']}, {y['n']} - {y['at']})"
    return f"100 * least({x['n']}, {y['n']}) >= 75 * greatest({x['n']}, {y['n']}) AND 7 * {left} >= 3 * ({x['n']} + {y['n']})"


def _labelled(index: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The index with the components that ``edges`` make, and the stars of these components, which stand for the edges from then on."""
    known = components(edges)
    rows = index.join(known.withColumnRenamed("node", "print"), "print", "left").withColumn("component", F.coalesce("component", "print"))
    return staged(rows), known.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))


def _star(index: DataFrame) -> DataFrame:
    """For each set one pair: with the most central set of its lists that is of another component and of a fitting size."""
    best = index.groupBy("token").agg(F.max(F.struct("central", "print", "n", "at", "component")).alias("r"), F.min("component").alias("low"), F.max("component").alias("high"))
    best = best.where("low != high").select("token", "r")
    met = index.join(best, "token").where(f"component != r.component AND {_fits('{}', 'r.{}')}")
    # central first, then by how many lists they meet in
    met = met.groupBy("print", F.col("r.print").alias("other")).agg(F.count("*").alias("lists"), F.max("r.central").alias("central"))
    return met.groupBy(F.col("print").alias("a")).agg(F.max_by("other", F.struct("lists", "central", "other")).alias("b"))


def _across(index: DataFrame) -> DataFrame:
    """All pairs of different components that meet in a list and can link by size and position.

    A list's entries lie in blocks by size class; only blocks of the same or
    the next class are joined, others are skipped whole.
    """
    mixed = index.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("token")
    rows = index.join(mixed, "token").withColumn("block", F.floor(F.log(F.col("n").cast("double")) / np.log(4 / 3)).cast("int"))
    cols = ("print", "n", "at", "component")
    left = rows.select("token", "block", *cols)
    right = rows.withColumn("block", F.explode(F.array("block", F.col("block") - 1, F.col("block") + 1))).select("token", "block", *[F.col(c).alias(f"{c}_") for c in cols])
    met = left.join(right, ["token", "block"]).where(f"component < component_ AND {_fits('{}', '{}_')}")
    return met.select(F.col("print").alias("a"), F.col("print_").alias("b"))


def join(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs``.

    Words are runs of non-white-space (A-Z lowered); a text of fewer than five
    words has one shingle, one without words (or null) none and links with
    nothing: its component is its own id. Texts with equal sets are one class.
    Repeated rows stay, each with its component; a row with a null id links its
    class but is nobody's smallest id (its component is null if no other row of
    it has one). An empty table gives an empty result; other columns are not
    read.
    """
    on_workers(docs.sparkSession)
    sets = staged(_sets(docs, doc, text))
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = min(20, max(LEAST_RANGES, int(max(total, 1) // RANGE_SHINGLES).bit_length()))
    shared = _ranges(docs, text, bits).groupBy("range").applyInArrow(_shared, "range int, batch long, tokens binary, places binary, counts binary")
    kept = shared.groupBy("batch").applyInArrow(_survivors, "print long, n long, central long, tokens binary, prefix array<long>, skipped int")
    kept = staged(kept.dropDuplicates(["print"]))
    index = kept.select("print", "n", "central", F.col("print").alias("component"), F.col("skipped").alias("alone"), F.posexplode("prefix").alias("at", "token"))
    index = index.withColumn("at", F.col("at") + F.col("alone")).drop("alone")
    # a list of one set has nothing to say
    several = index.groupBy("token").agg(F.min("print").alias("low"), F.max("print").alias("high")).where("low != high").select("token")
    index = staged(index.join(several, "token"))
    edges = staged(_linked(_star(index), kept))
    for step in (_star, _across):
        index, stars = _labelled(index.drop("component"), edges)
        edges = staged(stars.union(_linked(step(index), kept)))
    label = components(edges).withColumnRenamed("node", "print")
    classes = sets.where("n > 0").groupBy("print").agg(F.min("doc_id").alias("least"))
    classes = classes.join(label, "print", "left").withColumn("component", F.coalesce("component", "print"))
    smallest = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = classes.join(smallest, "component").select("print", "component_id")
    out = sets.where("n > 0").join(classes, "print", "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.union(sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
