"""Operator 6: substring dedup by paragraph MinHash banding.

A document's paragraphs are its lines, and, for passages that begin or end
within a line, pieces of ``PIECE`` words from
anchors that only the words around them decide (the least shingle hash of every
``REACH`` in a row). Any passage of ``REACH + PIECE - 1`` (50) words or more
that two documents share holds a piece that both have.

Lines are banded: ``BANDS`` bands of ``ROWS`` MinHashes find 99.8 % of the pairs
with a Jaccard similarity of 3/4; those of fewer than ``LEAST_BANDED`` shingles
are similar only to their equals and need no band. Lines that collide in a band
are joined: each, twice, with the line of its buckets that collides most. Lines that
then still share a bucket with another component are joined by their rarest shingles,
which are few enough to leave no pair of similarity 3/4 out: pairing all lines of a
bucket would grow with the square of the lines around one common passage. The pairs are verified
by their exact similarity and clustered by connected components; pieces are equal
or not, and their class is their cluster. Of a cluster the first occurrence (by
document, then place) stays and the others are spans to remove.

Equal texts are one class: its text is cut up once, and its documents share
what is found, each of them but the smallest losing every span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faretrail.llm import jaccard
from faretrail.llm import textarrays as ta
from faretrail.llm.common import components, on_workers, staged, unstaged

#: Fewest shingles of a set that can have a similarity of 3/4 with another set than itself (3 of 4).
LEAST_BANDED = 3
BANDS, ROWS = 16, 4
REACH, PIECE = 20, 31
#: Bytes of texts whose band keys make a range, and the fewest bits that number the ranges.
RANGE_BYTES, LEAST_BITS = 16 << 20, 8
#: Slots of the sieve that keeps most lines without a collision from the shuffle: eight a line, within these bounds.
LEAST_SLOTS, MOST_SLOTS = 1 << 16, 1 << 28
#: Slots in which shingles are counted to order them, the rare ones first.
ORDER_SLOTS = 1 << 20
GROUP = 2 << 20
#: Lines whose MinHashes are taken together.
TOGETHER = 2048
#: Pairs a line, as the lists' sizes bound them, up to which all pairs left are verified; more are joined centre first once more.
PAIRS_A_LINE = 2
SEEDS = ta.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * ta.BASE) | np.uint64(1)


def _lines(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the lines of all texts, and each line's text."""
    cuts = np.unique(np.concatenate([off, np.flatnonzero(raw == 10) + 1]))
    return cuts, np.searchsorted(off, cuts[:-1], "right") - 1


def _by_line(h: np.ndarray, line: np.ndarray, n: int) -> np.ndarray:
    """The order by line and hash; one key of 64 bits tells it, unless two hashes of a line differ in their last bits alone."""
    bits = n.bit_length()
    key = line.astype(np.uint64) << np.uint64(64 - bits) | h >> np.uint64(bits)
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    if (h[order[1:]][same] != h[order[:-1]][same]).any():
        return np.lexsort((h, line))
    return order


def _anchors(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The first least of every ``REACH`` hashes in a row of one text, each place once."""
    low, size = h, 1
    while size < REACH:  # least of runs twice as long, the last two overlapping
        step = min(size, REACH - size)
        low, size = np.minimum(low[:-step], low[step:]), size + step
    # the place stays until it is left behind or a smaller hash comes
    inside = doc[: len(low)] == doc[REACH - 1:]
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (low[1:] != low[:-1]) | (h[: len(low) - 1] == low[:-1])
    at = np.flatnonzero(new)
    return np.unique(np.lib.stride_tricks.sliding_window_view(h, REACH)[at].argmin(axis=1) + at)


def _line_sets(raw: np.ndarray, off: np.ndarray):
    """Words, lines with words, and their distinct shingles: hash and line, sizes and fingerprints by line."""
    cuts, of = _lines(raw, off)
    n = len(cuts) - 1
    w = ta.words(ta.LOWER[raw], cuts, ta.SPACED)
    h, line, _ = ta.windows(w, max(n, 1), jaccard.SHINGLE)
    order = _by_line(h, line, max(n, 1))
    h, line = h[order], line[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
    h, line = h[new], line[new]
    names, at, sizes = np.unique(line, return_index=True, return_counts=True)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ta.mix(h ^ jaccard.MORE), dtype=np.uint64)])
    prints = ta.mix(sums[at + sizes] - sums[at] + sizes.astype(np.uint64) * ta.BASE).view(np.int64)
    return w, cuts, of, h, names, at, sizes, prints


def _pieces(raw: np.ndarray, off: np.ndarray):
    """First word, last word, text and hash of the anchored pieces, with the words."""
    n = len(off) - 1
    w = ta.words(ta.LOWER[raw], off, ta.SPACED)
    h, doc, at = ta.windows(w, n, jaccard.SHINGLE)
    if len(h) < REACH:
        z = np.zeros(0, np.int64)
        return w, z, z, z, z
    first = at[_anchors(h, doc)]
    last = first + PIECE - 1
    ok = last < len(w.doc)
    ok[ok] = w.doc[last[ok]] == w.doc[first[ok]]
    first, last = first[ok], last[ok]
    x = np.zeros(len(first), np.uint64)
    for k in range(PIECE):
        x = ta.mix(x * ta.BASE + w.hash[first + k])
    return w, first, last, w.doc[first], x.view(np.int64)


def _groups(column) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    raw, off = ta.utf8(column)
    for i, j in ta.blocks(off, GROUP):
        yield raw[off[i]: off[j]], off[i: j + 1] - off[i], i, j


def _units(texts: DataFrame) -> DataFrame:
    """``(class, doc_id, top, start, end, print, line)``: every line and piece, its place in code points, its text's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, off, i, _ in _groups(batch.column(3)):
                points = ta.starts_of_points(raw)
                w, cuts, of, _, names, _, _, prints = _line_sets(raw, off)
                # a line's span is that of its words
                begin, end = np.searchsorted(w.doc, names), np.searchsorted(w.doc, names, "right")
                parts = [(of[names], w.start[begin], w.end[end - 1], prints, True)] if len(names) else []
                w, first, last, d, x = _pieces(raw, off)
                if len(first):
                    parts.append((d, w.start[first], w.end[last], x, False))
                for d, a, z, p, line in parts:
                    which = pa.array(i + d)
                    yield pa.record_batch({**{c: batch.column(c).take(which) for c in ("class", "doc_id", "top")}, "start": pa.array(points[a] - points[off[d]]),
                                           "end": pa.array(points[z] - points[off[d]]), "print": pa.array(p), "line": pa.array(np.full(len(d), line))})

    return texts.select("class", "doc_id", "top", "text").mapInArrow(
        run, "class long, doc_id long, top long, start long, end long, print long, line boolean")


def _bands(docs: DataFrame, text: str, bits: int) -> DataFrame:
    """``(range, keys, prints)``: the band hashes of distinct lines of a batch, packed by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[int, list[np.ndarray]] = {}
            for raw, off, _, _ in _groups(batch.column(0)):
                *_, h, _, at, sizes, prints = _line_sets(raw, off)
                # equal lines are one set, and the smallest sets have only equals
                one = np.unique(prints, return_index=True)[1]
                one = np.sort(one[sizes[one] >= LEAST_BANDED])
                if not len(one):
                    continue
                prints, at, sizes = prints[one], at[one], sizes[one]
                ends = np.cumsum(sizes)
                h = h[np.repeat(at - ends + sizes, sizes) + np.arange(ends[-1])]
                at = ends - sizes
                for i in range(0, len(one), TOGETHER):  # few enough lines for the processor's cache
                    own = at[i: i + TOGETHER] - at[i]
                    part = h[at[i]: at[i] + own[-1] + sizes[min(i + TOGETHER, len(one)) - 1]]
                    x, y = np.empty_like(part), np.empty_like(part)
                    for b in range(BANDS):
                        key = np.full(len(own), np.uint64(b + 1))
                        for k in range(ROWS):
                            np.multiply(part, SEEDS[b * ROWS + k], out=x)
                            np.right_shift(x, np.uint64(29), out=y)
                            np.bitwise_xor(x, y, out=x)
                            key = ta.mix(key * ta.BASE + np.minimum.reduceat(x, own))
                        seen.setdefault(b, []).append(np.stack([key, prints[i: i + TOGETHER].view(np.uint64)]))
            if not seen:
                continue
            key, prints = np.unique(np.concatenate([x for v in seen.values() for x in v], axis=1), axis=1)
            where = (key >> np.uint64(64 - bits)).astype(np.int32)
            names, at = np.unique(where, return_index=True)
            ends = np.append(at[1:], len(where))
            low = ((key >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype("<u4")
            yield pa.record_batch({"range": pa.array(names), "keys": pa.array([low[a:z].tobytes() for a, z in zip(at, ends, strict=True)], pa.binary()),
                                   "prints": pa.array([prints[a:z].tobytes() for a, z in zip(at, ends, strict=True)], pa.binary())})

    return docs.select(text).where(F.col(text).isNotNull()).mapInArrow(run, "range int, keys binary, prints binary")


def _collisions(table: pa.Table) -> pa.Table:
    """Of one range the band keys of more than one line set."""
    key = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in table.column("keys")]).astype(np.uint64)
    prints = np.concatenate([np.frombuffer(x.as_py(), "<u8") for x in table.column("prints")])
    order = np.lexsort((prints, key))
    key, prints = key[order], prints[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (prints[1:] != prints[:-1])
    key, prints = key[new], prints[new]
    _, which, times = np.unique(key, return_inverse=True, return_counts=True)
    keep = times[which] > 1
    token = (np.int64(table.column("range")[0].as_py()) << 32) | key[keep].astype(np.int64)
    return pa.table({"token": pa.array(token, pa.int64()), "print": pa.array(prints[keep].view(np.int64), pa.int64())})


def _sieve(prints: DataFrame) -> tuple[np.ndarray, int]:
    """Bits of the slots that hold a print, in words of 64, and the shift that leads to a slot; its size is bounded."""
    slots = min(MOST_SLOTS, max(LEAST_SLOTS, 1 << (8 * prints.count()).bit_length()))
    shift = 65 - slots.bit_length()
    slot = F.shiftrightunsigned("print", shift)
    words = prints.select(F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(print, {shift}) & 63 AS INT))").alias("bit"))
    rows = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(slots >> 6, np.uint64)
    bits[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return bits, shift


def _sets_of(docs: DataFrame, text: str, asked: DataFrame) -> DataFrame:
    """``(print, n, tokens, central)`` of the lines asked for; the tokens are the shingles, packed."""
    shared = docs.sparkSession.sparkContext.broadcast(_sieve(asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, shift = shared.value
        for batch in batches:
            for raw, off, _, _ in _groups(batch.column(0)):
                *_, h, _, at, sizes, prints = _line_sets(raw, off)
                _, one = np.unique(prints, return_index=True)
                slot = prints[one].view(np.uint64) >> np.uint64(shift)
                one = one[(bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)]
                yield pa.record_batch({"print": pa.array(prints[one]), "n": pa.array(sizes[one].astype(np.int64)),
                                       "tokens": pa.array([h[at[k]: at[k] + sizes[k]].astype("<u8").tobytes() for k in one], pa.binary())})

    found = docs.select(text).where(F.col(text).isNotNull()).mapInArrow(run, "print long, n long, tokens binary")
    # what the sieve lets through goes here
    return found.join(asked, "print").dropDuplicates(["print"])


def _rarest(index: DataFrame, sets: DataFrame) -> DataFrame:
    """The lines that still share a bucket with another component, listed by their rarest shingles instead of by bucket.

    Under any one order of the shingles, two sets with a similarity of 3/4 share
    one of the first ``n - ceil(3n/4) + 1`` of each; with the rare ones first, lines
    that merely hold the same common passage do not meet. The order is by the
    counts of ``ORDER_SLOTS`` slots of shingles, a table of fixed size.
    """
    spark = index.sparkSession
    mixed = index.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("token")
    rest = index.join(mixed, "token").select("print", "component").distinct()
    rest = staged(rest.join(sets, "print").select("print", "n", "central", "component", "tokens"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = np.zeros(ORDER_SLOTS, np.int64)
        for batch in batches:
            flat = np.frombuffer(b"".join(x.as_py() for x in batch.column(0)), "<i8")
            slot, n = np.unique(flat & (ORDER_SLOTS - 1), return_counts=True)
            times[slot] += n
        slot = np.flatnonzero(times)
        yield pa.record_batch({"slot": pa.array(slot), "times": pa.array(times[slot])})

    sums = rest.select("tokens").mapInArrow(counted, "slot long, times long").groupBy("slot").agg(F.sum("times").alias("times")).toArrow()
    times = np.zeros(ORDER_SLOTS, np.int64)
    times[sums.column("slot").to_numpy()] = sums.column("times").to_numpy()
    shared = spark.sparkContext.broadcast(times)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts, counts = [np.zeros(0, np.int64)], []
            for x in batch.column("tokens"):
                own = np.unique(np.frombuffer(x.as_buffer(), "<i8"))
                order = np.lexsort((own, shared.value[own & (ORDER_SLOTS - 1)]))
                firsts.append(own[order[: len(own) - jaccard.least_overlap(len(own)) + 1]])
                counts.append(len(firsts[-1]))
            counts = np.array(counts, np.int64)
            row = pa.array(np.repeat(np.arange(len(counts)), counts))
            at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            yield pa.record_batch({"token": pa.array(np.concatenate(firsts)), "at": pa.array(at),
                                   **{c: batch.column(c).take(row) for c in ("print", "n", "central", "component")}})

    out = rest.mapInArrow(listed, "token long, at long, print long, n long, central long, component long")
    several = out.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("token")
    made = staged(out.join(several, "token"))
    unstaged(rest)
    return made


def _pairs_left(index: DataFrame) -> int:
    """How many pairs of different components meet in the lists, at most, from the lists' sizes."""
    sizes = index.groupBy("token", "component").agg(F.count("*").cast("double").alias("n"))
    lists = sizes.groupBy("token").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"))
    return int(lists.agg(F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("own")) / 2), F.lit(0.0))).first()[0])


def line_clusters(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(print, cluster)`` of the line sets that have a similar one."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    bits = max(LEAST_BITS, int(size // RANGE_BYTES).bit_length())
    met = staged(_bands(docs, text, bits).groupBy("range").applyInArrow(_collisions, "token long, print long"))
    # the lines that collide, and in how many bands; only their sets are kept for verification
    asked = staged(met.groupBy("print").agg(F.count("*").alias("central")))
    sets = staged(_sets_of(docs, text, asked))
    # the buckets of the bands, joined centre first; nothing but sizes can tell two lines of a bucket apart beforehand
    index = staged(met.join(sets.select("print", "n", "central"), "print").select(
        "token", "print", "n", F.lit(0).cast("long").alias("at"), "central", F.col("print").alias("component")))
    unstaged(met), unstaged(asked)
    edges = staged(jaccard._linked(jaccard._star(index), sets))
    lines, left, k, step = sets.count(), None, 0, jaccard._star
    while step is jaccard._star:
        before, (index, stars) = index, jaccard._labelled(index.drop("component"), edges)
        unstaged(before)
        if k == 1:  # what the buckets' centres leave goes on by rare shingles
            before, index = index, _rarest(index, sets)
            unstaged(before)
        if k > 1:  # centres go on as long as they halve what is left
            last, left = left, _pairs_left(index)
            if left <= PAIRS_A_LINE * lines or last is not None and 2 * left > last:
                step = jaccard._across
        k += 1
        edges = staged(stars.union(jaccard._linked(step(index), sets)))
    unstaged(index), unstaged(sets)
    return components(edges).select(F.col("node").alias("print"), F.col("component").alias("cluster"))


def _merged(spans: pa.Array) -> pa.Array:
    """Each row's spans in order, those that overlap or touch as one."""
    sizes = spans.value_lengths().fill_null(0).to_numpy()
    flat = spans.flatten()
    # a row's places lie in a range of their own
    base = np.repeat(np.arange(len(spans), dtype=np.int64) << 40, sizes)
    start, end = (flat.field(c).to_numpy() + base for c in ("start", "end"))
    order = np.argsort(start, kind="stable")
    start, top = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > top[:-1]
    at = np.flatnonzero(new)
    start, end = start[at], top[np.append(at[1:], len(top))[: len(at)] - 1]
    row = start >> 40
    off = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(spans)))]).astype(np.int32)
    made = pa.StructArray.from_arrays([pa.array(start - (row << 40)), pa.array(end - (row << 40))], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(off), made)


def repeats(docs: DataFrame, doc: str = "doc_id", text: str = "text", within: bool = False) -> DataFrame:
    """A row for every document that holds a paragraph or piece repeated in another document; others have none.

    ``keep_doc_ids``: the documents whose copies stay, for each of its clusters
    (itself where its own copy stays); ``n_repeated``: its occurrences;
    ``removals``: merged spans to remove (code points, end exclusive). With
    ``within``, clusters that only one document holds, more than once, count
    too: a column ``spans_documents`` tells them from the others, and a document
    that has clusters of both kinds has a row for each. Rows with
    a null id or text are left out; repeated rows of one id count as one
    document; an empty table gives no rows.
    """
    on_workers(docs.sparkSession)
    given = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    given = given.withColumn("digest", F.md5(F.col("text").cast("binary")))
    # a text's documents are numbered by it; its lines and pieces carry the least and the greatest of them
    texts = given.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("top"), F.first("text").alias("text"))
    texts = staged(texts.withColumn("class", F.monotonically_increasing_id()))
    members = given.groupBy("digest", "doc_id").agg(F.count("*").alias("times"))
    members = staged(members.join(texts.select("digest", "class"), "digest").drop("digest"))
    clusters = line_clusters(texts)
    units = staged(_units(texts))
    unstaged(texts)
    # a piece's print is its cluster; so is that of a line without a similar one
    named = units.where("line").join(clusters, "print", "left").withColumn("cluster", F.coalesce("cluster", "print"))
    units = named.unionByName(units.where("NOT line").withColumn("cluster", F.col("print"))).drop("print")
    first = units.groupBy("line", "cluster").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.max("top").alias("other"), F.count("*").alias("copies"))
    first = first.withColumn("spans_documents", F.expr("first.doc_id != other")).where("spans_documents OR copies > 1" if within else "spans_documents")
    found = units.join(first, ["line", "cluster"])
    # several pieces of one passage and its copies are one row a text
    span, stays = F.struct("start", "end"), F.expr("first.doc_id = doc_id AND first.start = start")
    found = found.groupBy("class", "spans_documents").agg(F.min("doc_id").alias("low"), F.collect_set("first.doc_id").alias("keeps"), F.count("*").alias("n"),
                                       F.collect_set(F.when(~stays, span)).alias("goes"), F.collect_set(F.when(stays, span)).alias("own"))
    rows = members.join(found, "class").select("doc_id", "spans_documents", "keeps", (F.col("n") * F.col("times")).alias("n"),
                                               F.when(F.col("doc_id") == F.col("low"), F.col("goes")).otherwise(F.array_union("goes", "own")).alias("spans"))
    rows = rows.groupBy("doc_id", "spans_documents").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("keeps")))).alias("keep_doc_ids"), F.sum("n").alias("n_repeated"),
                                      F.flatten(F.collect_list("spans")).alias("spans"))
    merged = F.arrow_udf(_merged, "array<struct<start:bigint,end:bigint>>")("spans")
    return rows.select("doc_id", "keep_doc_ids", "n_repeated", merged.alias("removals"), *(["spans_documents"] if within else []))
