"""Operator 9: token ids in files of fixed-width bit packing.

A file is a run of blocks. A block is

    magic "TPB1" | bits u4 | documents u4 | ids u8 | doc_id i8 each (with a
    null bitmap after them) | first id of each document u8, and the total |
    packed ids, ``bits`` each, least significant bit first | end mark

so that a document's ids are found from the offsets and unpacked alone. Blocks
are rows of a text sink whose line separator is the end mark, so Spark's own
commit protocol writes the files, whatever store they are in, and a lost
executor leaves none behind.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faretrail.llm.chunks import encoder
from faretrail.llm.common import on_workers, staged

MAGIC, END = b"TPB1", b"TPBE"
HEAD = struct.Struct("<4sIIQ")
#: Ids after which a block is closed.
BLOCK_IDS = 1 << 20
#: Blocks of a file; a block holds little more than ``BLOCK_IDS`` ids unless one document alone has more.
FILE_BLOCKS = 128


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold every id below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids at ``bits`` bits each, least significant bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    out = []
    for i in range(0, len(ids), 1 << 16):
        part = ids[i: i + (1 << 16)].astype(np.uint32)
        out.append(np.packbits(((part[:, None] >> np.arange(bits, dtype=np.uint32)) & 1).astype(np.uint8).ravel(), bitorder="little"))
    return np.concatenate(out).tobytes() if out else b""


def unpack(data: bytes | memoryview, bits: int, first: int, count: int) -> np.ndarray:
    """``count`` ids from id ``first`` on; reads only the bytes that hold them."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count, first * bits // 8).astype(np.uint32)
    low, high = first * bits, (first + count) * bits
    raw = np.frombuffer(data, np.uint8, -(-high // 8) - low // 8, low // 8)
    flat = np.unpackbits(raw, bitorder="little")[low % 8: low % 8 + count * bits].reshape(count, bits)
    return flat.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def block_bytes(docs: list[int | None], ids: list[np.ndarray], bits: int) -> bytes:
    total = sum(map(len, ids))
    offsets = np.zeros(len(docs) + 1, "<u8")
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    names = np.array([d or 0 for d in docs], "<i8")
    nulls = np.packbits(np.array([d is None for d in docs], np.uint8))
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    return b"".join([HEAD.pack(MAGIC, bits, len(docs), total), names.tobytes(), nulls.tobytes(), offsets.tobytes(), pack(flat, bits)])


class Block:
    """A block read back; :meth:`ids` unpacks any one document's ids."""

    def __init__(self, data: memoryview):
        magic, self.bits, n, total = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token block")
        at = HEAD.size
        names = np.frombuffer(data, "<i8", n, at)
        at += 8 * n
        nulls = np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), at), count=n).astype(bool)
        at += -(-n // 8)
        self.docs = [None if x else int(d) for d, x in zip(names, nulls, strict=True)]
        self.offsets = np.frombuffer(data, "<u8", n + 1, at).astype(np.int64)
        at += 8 * (n + 1)
        self.size = at + -(-total * self.bits // 8)
        self.packed = data[at: self.size]
        if data[self.size: self.size + len(END)] != END:
            raise ValueError("a token block without its end mark")

    def ids(self, k: int) -> np.ndarray:
        return unpack(self.packed, self.bits, int(self.offsets[k]), int(self.offsets[k + 1] - self.offsets[k]))


def blocks_of(data: bytes) -> Iterator[Block]:
    view, at = memoryview(data), 0
    while at < len(view):
        b = Block(view[at:])
        yield b
        at += b.size + len(END)


def write_ids(df: DataFrame, path: str, tokenizer: str, end_id: int, vocabulary: int | None = None,
              doc: str = "doc_id", text: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Encode every text, append ``end_id`` and write the ids to ``path`` in ascending order of ``doc``.

    Documents are dealt by ranges of (doc, text hash), so equal ids may share
    several files; files in the order of their task's and their own number, both
    in the name, are in document order. Null texts count as
    empty (the end id alone), null ids come first, rows with equal ids all stay
    (ordered by the text's hash). ``vocabulary`` defaults to the tokenizer's;
    ids are stored in the fewest bits that hold it.
    """
    on_workers(df.sparkSession)
    h = F.xxhash64(text)
    rows = df.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text"), h.alias("h"))
    rows = rows.repartitionByRange("doc", "h").sortWithinPartitions("doc", "h").select("doc", "text")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        size = vocabulary or max(enc.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
        bits = bits_for(size)
        docs, ids, held = [], [], 0
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), enc.encode_many(batch.column(1)), strict=True):
                docs.append(name)
                ids.append(np.append(np.frombuffer(raw, enc.dtype), np.array([end_id], enc.dtype)))
                held += len(ids[-1])
                if held >= block_ids:
                    yield pa.record_batch({"block": pa.array([block_bytes(docs, ids, bits)], pa.binary())})
                    docs, ids, held = [], [], 0
        if docs:
            yield pa.record_batch({"block": pa.array([block_bytes(docs, ids, bits)], pa.binary())})

    (rows.mapInArrow(encoded, "block binary").select(F.col("block").cast("string").alias("value"))
     .write.option("lineSep", END.decode()).option("maxRecordsPerFile", FILE_BLOCKS).text(path))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Per document: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``.

    Files are read whole by a task each; their sizes are the partitions' that
    were written. Only totals by file (one row a file) are summed up in order.
    """
    on_workers(spark)
    files = spark.read.format("binaryFile").load(path).where("length > 0").select(
        F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name, before = batch.column(0)[k].as_py(), 0
                for b in blocks_of(batch.column(1)[k].as_buffer()):
                    n = np.diff(b.offsets)
                    crc = [zlib.crc32(b.ids(i).astype("<u4").tobytes()) for i in range(len(b.docs))]
                    yield pa.record_batch({
                        "file": pa.array([name] * len(n)), "doc_id": pa.array(b.docs, pa.int64()),
                        "within": pa.array(before + b.offsets[:-1], pa.int64()), "n_tokens": pa.array(n, pa.int64()),
                        "ids_crc32": pa.array(crc, pa.int64())})
                    before += int(b.offsets[-1])

    # a row a document, read twice: the ids are unpacked once
    docs = staged(files.mapInArrow(parsed, "file string, doc_id long, within long, n_tokens long, ids_crc32 long"))
    number = [F.regexp_extract("file", p, 1).cast("long") for p in (r"^part-(\d+)", r"-c(\d+)")]
    totals = docs.groupBy("file").agg(F.sum("n_tokens").alias("ids"))
    order = Window.orderBy(*number).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("file", F.coalesce(F.sum("ids").over(order), F.lit(0)).cast("long").alias("before"))
    return docs.join(totals, "file").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
