"""Operator 3: WARC archives with segmented records and chunked payloads.

Writing: a record a page; a response's HTTP block is framed in chunks and cut
into a first record and continuation records when it is long. Records are rows
of a text sink whose line separator is the end of a WARC record, so Spark's
commit protocol writes the archives and a lost executor leaves none behind.
Reading: records are parsed file by file; continuation records are grouped by
their origin, ordered by segment number, held against the total length, and the
chunked framing is decoded.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faretrail.llm.common import on_workers

END = "\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
#: Bytes of a block from which on it continues in another record.
SEGMENT = 32 << 10
CHUNK = 8 << 10
#: Records of one archive file.
FILE_RECORDS = 4096
NAMESPACE = uuid.UUID("6ba7b812-9dad-11d1-80b4-00c04fd430c8")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, sha: str) -> str:
    """The same for a page's record wherever it is named."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}:{sha}')}>"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(c := payload[i: i + size]), c) for i in range(0, len(payload), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(data: bytes) -> bytes | None:
    """The payload of a chunked body, chunk extensions and trailers passed over; None if it is broken."""
    out, at = [], 0
    while True:
        line = data.find(b"\r\n", at)
        if line < 0:
            return None
        try:
            n = int(data[at:line].split(b";")[0], 16)
        except ValueError:
            return None
        at = line + 2
        if n == 0:
            return b"".join(out) if data.find(b"\r\n", at) >= 0 else None
        out.append(data[at: at + n])
        if len(out[-1]) != n or data[at + n: at + n + 2] != b"\r\n":
            return None
        at += n + 2


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in headers if v is not None], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END.encode() + block


def records(page_id: int | None, url: str | None, payload: bytes, keeper: int | None, date: str, segment: int) -> Iterator[bytes]:
    sha = digest(payload)
    common = [("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%~") if url else None), ("WARC-Date", date),
              ("WARC-Payload-Digest", f"sha1:{sha}"), ("X-Page-Id", page_id)]
    own = record_id(page_id, sha)
    if keeper is not None and keeper != page_id:
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                       ("WARC-Refers-To", record_id(keeper, sha)), ("X-Refers-To-Page", keeper), *common, ("Content-Type", "application/http; msgtype=response")],
                      HTTP + b"Content-Length: %d\r\n\r\n" % len(payload))
        return
    block = HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    kind = ("Content-Type", "application/http; msgtype=response")
    if len(block) <= segment:
        yield _record([("WARC-Type", "response"), ("WARC-Record-ID", own), *common, kind], block)
        return
    cuts = range(0, len(block), segment)
    for k, at in enumerate(cuts, 1):
        part = block[at: at + segment]
        if k == 1:
            yield _record([("WARC-Type", "response"), ("WARC-Record-ID", own), ("WARC-Segment-Number", 1), *common, kind], part)
        else:
            yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(page_id, f"{sha}:{k}")), ("WARC-Segment-Origin-ID", own),
                           ("WARC-Segment-Number", k), ("WARC-Date", date), ("WARC-Segment-Total-Length", len(block) if k == len(cuts) else None)], part)


def write(pages: DataFrame, path: str, date: str = "2026-01-01T00:00:00Z", segment: int = SEGMENT) -> None:
    """Write archives with a record for every row of ``pages`` (page_id, url, html).

    Null html counts as empty, a null url has no target. Of rows with equal
    payloads those with the largest page_id are responses, the others revisit
    it (rows that repeat the largest id are all responses; a null id revisits
    if the group has any other). Other columns are not written.
    """
    on_workers(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("html")))
    keepers = rows.groupBy("sha").agg(F.max("page_id").alias("keeper"))
    rows = rows.join(keepers, "sha").select("page_id", "url", "html", "keeper")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for k in range(batch.num_rows):
                page, url, html, keeper = (c[k].as_py() for c in batch.columns)
                for r in records(page, url, html.encode(), keeper, date, segment):
                    out.append(r)
                    size += len(r)
                if size > 4 << 20:
                    yield pa.record_batch({"record": pa.array(out, pa.binary())})
                    out, size = [], 0
            yield pa.record_batch({"record": pa.array(out, pa.binary())})

    (rows.mapInArrow(made, "record binary").select(F.col("record").cast("string").alias("value"))
     .write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path))


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record; a broken archive raises ``ValueError``."""
    at, end = 0, END.encode()
    while at < len(data):
        stop = data.find(end, at)
        if stop < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        lines = data[at:stop].decode().split("\r\n")[1:]
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        begin = stop + len(end)
        n = int(headers["content-length"])
        if data[begin + n: begin + n + len(end)] != end:
            raise ValueError(f"the record at byte {at} does not end where its length says")
        yield headers, data[begin: begin + n]
        at = begin + n + len(end)


def body(block: bytes) -> bytes | None:
    """The payload of an HTTP block."""
    head, found, rest = block.partition(b"\r\n\r\n")
    if not found:
        return None
    return unchunked(rest) if b"transfer-encoding: chunked" in head.lower() else rest


PAGE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, complete boolean"


def _page(page: int | None, said: str, block: bytes, whole: bool) -> dict:
    payload = body(block) if whole else None
    sha = digest(payload) if payload is not None else None
    return {"page_id": page, "payload_bytes": None if payload is None else len(payload), "payload_digest": sha, "record_type": "response",
            "refers_to": None, "payload": payload, "complete": sha is not None and f"sha1:{sha}" == said}


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row for every response or revisit record of the archives under ``path``.

    ``payload_bytes`` and ``payload_digest`` are those of the full payload (a
    revisit's from its headers, its payload null). ``complete`` is false, and
    the payload null, where a segment is missing, the segments' lengths do not
    add up to the total, or framing is broken; also where the payload does not
    have the digest that the record names. Only records in segments are
    shuffled; a group is one record.
    """
    on_workers(spark)
    arrow = spark.createDataFrame([], PAGE + ", origin string, segment int, total long, said string, block binary").schema

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data = content.as_buffer().to_pybytes()
                rows = []
                for h, block in parse(_gunzip(data) if data[:2] == b"\x1f\x8b" else data):
                    page = int(h["x-page-id"]) if "x-page-id" in h else None
                    said = h.get("warc-payload-digest", "")
                    if h["warc-type"] == "revisit":
                        length = [v for k, _, v in (x.partition(b":") for x in block.split(b"\r\n")) if k.lower() == b"content-length"]
                        rows.append({"page_id": page, "payload_bytes": int(length[0]) if length else None, "payload_digest": said.removeprefix("sha1:"), "record_type": "revisit",
                                     "refers_to": int(h["x-refers-to-page"]), "complete": True})
                    elif "warc-segment-number" in h:
                        total = h.get("warc-segment-total-length")
                        rows.append({"page_id": page, "origin": h.get("warc-segment-origin-id", h["warc-record-id"]), "segment": int(h["warc-segment-number"]),
                                     "total": int(total) if total else None, "said": said, "block": block})
                    elif h["warc-type"] == "response":
                        rows.append(_page(page, said, block, True))
                    if len(rows) == 512:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                parts = {p["segment"]: p for p in row["parts"]}
                copies = sum(p["segment"] == 1 for p in row["parts"])
                block = b"".join(parts[k]["block"] for k in sorted(parts))
                first, last = parts.get(1), parts[max(parts)]
                whole = first is not None and sorted(parts) == list(range(1, len(parts) + 1)) and last["total"] == len(block)
                made = _page(first["page_id"] if first else None, first["said"] if first else "", block, whole)
                yield pa.RecordBatch.from_pylist([made] * max(copies, 1), page_schema)

    schema = pa.schema([(f.name, {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}[f.dataType.simpleString()]) for f in arrow.fields])
    page_schema = pa.schema(list(schema)[:7])
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in arrow.fields)
    found = spark.read.format("binaryFile").load(path).where("length > 0").select("content").mapInArrow(parsed, kinds)
    whole = found.where("origin IS NULL").select(*[f.name for f in arrow.fields[:7]])
    parts = found.where("origin IS NOT NULL").groupBy("origin").agg(F.collect_list(F.struct("segment", "total", "page_id", "said", "block")).alias("parts"))
    return whole.unionByName(parts.select("parts").mapInArrow(joined, PAGE))


def _gunzip(data: bytes) -> bytes:
    """All members of a gzip file."""
    out = []
    while data:
        d = zlib.decompressobj(31)
        out.append(d.decompress(data))
        data = d.unused_data
    return b"".join(out)
