"""Operator 13: lines that many documents repeat, as keep bitmaps.

Each task hashes the long lines of its documents, one row a document and
distinct line. The rows are dealt by ranges of (hash, document) and sorted by
them, the largest document first, so a line of very many documents spans
several tasks. A task streams its rows: of a line's documents the first stays,
the second goes as soon as a third is seen, and all from the third on go. Only
the first two documents of the first and last line of a range cannot be decided
there; they, at most four documents a range, are settled by a window over them. What
goes is put together a document, as a compressed bitmap of the lines that stay;
texts are not moved for it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType

from faretrail.llm import textarrays as ta
from faretrail.llm.common import fresh_name, on_workers, shuffle_partitions, staged

LEAST_POINTS = 20
LEAST_DOCS = 3
#: Documents that lose lines up to which their bitmaps are broadcast; more are joined by a shuffle.
BROADCAST_DOCS = 200_000
#: Bytes of these bitmaps up to which they are broadcast.
BROADCAST_BYTES = 32 << 20
#: Rows of one line that a task holds undecided; it passes further ones on.
HELD = 10_000
SPACE = b" \t\n\x0b\x0c\r"
LINE_ROWS = "h1 long, h2 long, none boolean, doc long, version long, lines array<int>"


def key_of(line: bytes, least: int = LEAST_POINTS) -> bytes | None:
    """The line stripped of white space, A-Z lower-cased; none if it has fewer than ``least`` code points."""
    key = line.strip(SPACE)
    if len(key) < least:
        return None
    key = key.lower()
    if len(key) < 4 * least and not key.isascii() and len(key.decode()) < least:
        return None
    return key


def line_rows(docs: DataFrame, doc: str, text: str, least_points: int) -> DataFrame:
    """One row a document, version of its text and distinct long line: 128 bits of the key's hash, and where the line stands."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = ta.utf8(batch.column(2))
            digests, rows, sizes, places = [], [], [], []
            for k in range(batch.num_rows):
                held: dict[bytes, list[int]] = {}
                for at, line in enumerate(raw[off[k]: off[k + 1]].tobytes().split(b"\n")):
                    if (key := key_of(line, least_points)) is not None:
                        held.setdefault(hashlib.blake2b(key, digest_size=16).digest(), []).append(at)
                digests += held
                rows += [k] * len(held)
                for x in held.values():
                    sizes.append(len(x))
                    places += x
            h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            lines = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(places, pa.int32()))
            names = batch.column(0).take(pa.array(rows, pa.int32()))
            yield pa.record_batch({"h1": pa.array(h[:, 0]), "h2": pa.array(h[:, 1]), "none": names.is_null(), "doc": names.fill_null(0),
                                   "version": batch.column(1).take(pa.array(rows, pa.int32())), "lines": lines})

    given = docs.select(F.col(doc).cast("long").alias("doc"), F.xxhash64(text).alias("version"), F.col(text).alias("text"))
    return given.mapInArrow(hashed, LINE_ROWS)


class Stream:
    """First occurrences in sorted rows: which rows go, and which a task alone cannot decide."""

    def __init__(self, least_docs: int):
        self.least = least_docs
        self.key: tuple | None = None  # the line of the rows at hand
        self.doc: tuple | None = None
        self.rank = 0  # how many of its documents have been seen
        self.held: list[tuple[int, dict]] = []  # rows whose fate hangs on further documents, the first row first
        self.open = True  # the line may begin in an earlier range, or rows of it have been passed on undecided

    def _passed_on(self, rows: list[tuple[int, dict]]) -> list[dict]:
        return [r | {"docs": min(self.rank, self.least), "settled": False} for _, r in rows]

    def _close(self, last: bool) -> list[dict]:
        """End the line at hand: inside the range its rows stay; at an edge they are passed on."""
        out = self._passed_on(self.held) if self.open or last else []
        self.held, self.open = [], False
        return out

    def feed(self, rows: dict[str, list]) -> Iterator[dict]:
        names = list(rows)
        for values in zip(*rows.values(), strict=True):
            row = dict(zip(names, values))
            key, doc = (row["h1"], row["h2"]), (row["none"], row["doc"])
            if key != self.key:
                if self.key is not None:
                    yield from self._close(False)
                self.key, self.doc, self.rank = key, None, 0
            if doc != self.doc:
                self.doc = doc
                self.rank += 1
                if self.rank == self.least:  # enough documents: all but the first go
                    yield from (r | {"docs": 0, "settled": True} for rank, r in self.held if rank > 1)
                    self.held = [x for x in self.held if x[0] == 1]
            if 1 < self.rank and self.rank >= self.least:
                yield row | {"docs": 0, "settled": True}
                continue
            self.held.append((self.rank, row))
            if len(self.held) > HELD:  # an id of very many texts
                yield from self._passed_on(self.held[1:])
                self.held, self.open = self.held[:1], True

    def end(self) -> Iterator[dict]:
        if self.key is not None:
            yield from self._close(True)


def dropped_lines(rows: DataFrame, least_docs: int, partitions: int | None = None) -> DataFrame:
    """``(none, doc, version, lines)``: the lines that go, of :func:`line_rows`."""
    order = ["h1", "h2", "none", F.col("doc").desc()]
    dealt = rows.repartitionByRange(partitions or shuffle_partitions(rows.sparkSession), *order, "version").sortWithinPartitions(*order)

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = Stream(least_docs)
        kind = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("none", pa.bool_()), ("doc", pa.int64()), ("version", pa.int64()),
                          ("lines", pa.list_(pa.int32())), ("docs", pa.int32()), ("settled", pa.bool_())])
        for batch in batches:
            yield pa.RecordBatch.from_pylist(list(_fed(stream, batch)), kind)
        yield pa.RecordBatch.from_pylist(list(stream.end()), kind)

    told = staged(dealt.mapInArrow(streamed, LINE_ROWS + ", docs int, settled boolean"))
    # a range tells all documents of a line that it cannot decide, or one and that there were enough
    open_rows = told.where("NOT settled")
    own = open_rows.groupBy("h1", "h2", "none", "doc").agg(F.max("docs").alias("docs"))
    line = Window.partitionBy("h1", "h2")
    own = own.select("h1", "h2", "none", "doc", F.greatest(F.max("docs").over(line), F.count("*").over(line)).alias("docs"),
                     F.row_number().over(line.orderBy("none", F.col("doc").desc())).alias("place"))
    go = own.where((F.col("docs") >= least_docs) & (F.col("place") > 1)).select("h1", "h2", "none", "doc")
    kept = ["none", "doc", "version", "lines"]
    return told.where("settled").select(kept).unionByName(open_rows.join(go, ["h1", "h2", "none", "doc"], "left_semi").select(kept))


def _fed(stream: Stream, batch: pa.RecordBatch) -> Iterator[dict]:
    """Feed a sorted batch; lines of one document inside it need no look at their rows."""
    n = batch.num_rows
    if not n:
        return
    h1, h2 = (batch.column(k).to_numpy() for k in (0, 1))
    change = np.ones(n + 1, bool)
    change[1:n] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    edges = np.flatnonzero(change)
    size = np.diff(edges)
    # a line of one row alone goes nowhere, except at the batch's ends, where the stream has to see it
    look = np.repeat(size > 1, size)
    look[: edges[1]] = look[edges[-2]:] = True
    part = batch.filter(pa.array(look))
    yield from stream.feed({name: part.column(k).to_pylist() for k, name in enumerate(part.schema.names)})


def bitmap(n_lines: int, dropped: np.ndarray) -> bytes:
    """Compressed bits of the lines that stay, first line first, filled up to whole bytes with lines that stay."""
    keep = np.ones(-(-n_lines // 8) * 8, bool)
    keep[dropped] = False
    return zlib.compress(np.packbits(keep).tobytes(), 1)


def kept_lines(text: bytes, bits: bytes) -> bytes:
    """The lines of ``text`` that its bitmap keeps, and those after its end, joined by line feeds."""
    lines = text.split(b"\n")
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8)).tolist()
    return b"\n".join([x for x, k in zip(lines, keep) if k] + lines[len(keep):])


def keep_bitmaps(docs: DataFrame, doc: str = "doc_id", text: str = "text", least_points: int = LEAST_POINTS,
                 least_docs: int = LEAST_DOCS, partitions: int | None = None) -> DataFrame:
    """Add ``n_lines``, ``n_dropped`` and ``keep_bits`` (null where every line stays) to every row; no text is changed.

    A line's key is the line stripped of white space with A-Z lower-cased.
    Keys of at least ``least_points`` code points that ``least_docs`` (1 or
    more) documents hold lose all their lines but those in the largest id
    holding them. Documents are told apart by id: rows of one id count as one
    document, rows without an id as another one below all others; rows of
    equal id and text get equal results. Null and empty texts are one empty
    line. Columns of these names are replaced; an empty table stays empty.
    """
    on_workers(docs.sparkSession)
    rows = staged(line_rows(docs, doc, text, least_points))
    gone = dropped_lines(rows, least_docs, partitions)

    @F.arrow_udf("struct<n_dropped:bigint,keep_bits:binary>", ArrowUDFType.SCALAR)
    def packed(lists: pa.Array) -> pa.Array:
        # lines after the last one that goes stay, so the bitmap ends there
        flat = [np.concatenate([np.asarray(x, np.int64) for x in own]) for own in lists.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([len(x) for x in flat], pa.int64()), pa.array([bitmap(int(x.max()) + 1, x) for x in flat], pa.binary())],
                                          ["n_dropped", "keep_bits"])

    names = ("none", "doc", "version")
    # a line stands in one list of its document, so only repeated rows have equal lists
    gone = gone.groupBy(*names).agg(F.collect_set("lines").alias("lists")).select(*names, packed("lists").alias("packed"))
    taken = [fresh_name(docs, c) for c in (*names, "packed")]
    gone = staged(gone.toDF(*taken))
    size = gone.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(f"{taken[3]}.keep_bits")), F.lit(0)).alias("bytes")).first()
    if size.n <= BROADCAST_DOCS and size.bytes <= BROADCAST_BYTES:
        gone = F.broadcast(gone)
    number = F.col(doc).cast("long")
    marked = docs.select("*", number.isNull().alias(taken[0]), F.coalesce(number, F.lit(0)).alias(taken[1]), F.xxhash64(text).alias(taken[2]))
    made = ("n_lines", "n_dropped", "keep_bits")
    body = F.coalesce(F.col(text), F.lit(""))
    return marked.join(gone, taken[:3], "left").select(
        *[f"`{c}`" for c in docs.columns if c.lower() not in made],
        (F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.col(f"{taken[3]}.n_dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.col(f"{taken[3]}.keep_bits").alias("keep_bits"))


def kept_text(text: str = "text", keep_bits: str = "keep_bits") -> F.Column:
    """The text without the lines that go (null: empty); only texts that lose lines are sent to Python."""

    @F.arrow_udf("string", ArrowUDFType.SCALAR)
    def cut(texts: pa.Array, bits: pa.Array) -> pa.Array:
        return pa.array([None if b is None else kept_lines(t.encode(), b).decode() for t, b in zip(texts.to_pylist(), bits.to_pylist(), strict=True)], pa.string())

    goes = F.col(keep_bits).isNotNull()
    return F.coalesce(cut(F.when(goes, F.col(text)), F.col(keep_bits)), F.col(text), F.lit(""))
