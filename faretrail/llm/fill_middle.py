"""Operator 12: fill-in-middle transformation by Fenwick trees over text blocks.

A text's UTF-8 bytes are cut into blocks of a fixed size. A Fenwick tree over
the blocks holds how many units and how many code points begin in each, so a
cut after any number of units is found by a descent of binary lifting to its
block and a search inside that block alone, and the code points before it come
out of the same descent.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType

from faretrail.llm import textarrays as ta
from faretrail.llm.common import fresh_name, on_workers

#: Bytes of a block.
BLOCK = 4096
#: Marks before the prefix, the suffix and the middle.
MARKS = (b"<P>", b"<S>", b"<M>")
MADE = {"n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint", "output_sha256": "string", "restored_sha256": "string"}


def unit_starts(raw: np.ndarray, unit: str) -> np.ndarray:
    """True for each byte at which a unit begins; the units of a text join up to the text.

    ``point``: code points. ``word``: white space with the word after it.
    ``line``: lines with their line feed.
    """
    if unit == "point":
        return (raw & 0xC0) != 0x80
    start = np.zeros(len(raw), bool)
    if unit == "word":
        word = ta.SPACED[raw]
        start[1:] = ~word[1:] & word[:-1]
    elif unit == "line":
        start[1:] = raw[:-1] == 10
    else:
        raise ValueError(f"no unit {unit!r}")
    start[:1] = True
    return start


class Cuts:
    """Fenwick tree over the blocks of one text; column 0 counts units, column 1 code points."""

    def __init__(self, raw: np.ndarray, unit: str = "point", block: int = BLOCK):
        self.size, self.block = len(raw), block
        self.starts = unit_starts(raw, unit)
        self.points = self.starts if unit == "point" else unit_starts(raw, "point")
        edges = np.arange(0, len(raw), block)
        per_block = np.stack([np.add.reduceat(x, edges, dtype=np.int64) if len(edges) else np.zeros(0, np.int64) for x in (self.starts, self.points)], 1)
        upto = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(per_block, 0)])
        node = np.arange(len(edges) + 1)
        self.tree = upto[node] - upto[node - (node & -node)]  # node k: the blocks of its lowest set bit that end at k
        self.n, self.n_points = (int(x) for x in upto[-1])

    def after(self, units: int) -> tuple[int, int]:
        """Byte and code points at which ``units`` units have ended."""
        if units >= self.n:
            return self.size, self.n_points
        at, points, step = 0, 0, 1 << (len(self.tree) - 1).bit_length()
        while step:
            to = at + step
            if to < len(self.tree) and self.tree[to, 0] <= units:
                units -= int(self.tree[to, 0])
                points += int(self.tree[to, 1])
                at = to
            step >>= 1
        first = at * self.block
        byte = first + int(np.flatnonzero(self.starts[first: first + self.block])[units])
        return byte, points + int(np.count_nonzero(self.points[first: byte]))


def numbers(seed: int, doc: int | None) -> list[int]:
    """The first four 8-digit groups of the hex SHA-256 of ``seed:doc`` (a null id is written as nothing)."""
    digest = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).digest()
    return [int.from_bytes(digest[k: k + 4], "big") for k in (0, 4, 8, 12)]


def transform(text: bytes, raw: np.ndarray, h: list[int], unit: str, rate: int, spm: int) -> tuple[bytes, int, str, int | None, int | None]:
    """Output, units, form, and the code points of prefix and middle (none if plain)."""
    p, s, m = MARKS
    cuts = Cuts(raw, unit)
    if not text or any(x in text for x in MARKS) or h[2] % 100 >= rate:
        return text, cuts.n, "plain", None, None
    low, high = sorted(x % (cuts.n + 1) for x in h[:2])
    (a, before), (b, upto) = cuts.after(low), cuts.after(high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm:
        return b"".join([s, suffix, p, prefix, m, middle]), cuts.n, "spm", before, upto - before
    return b"".join([p, prefix, s, suffix, m, middle]), cuts.n, "psm", before, upto - before


def restore(output: bytes, form: str) -> bytes:
    """The text that an output of this form was made from; ``ValueError`` if its marks are not there."""
    if form == "plain":
        return output
    p, s, m = MARKS
    first, second = (p, s) if form == "psm" else (s, p)
    if not output.startswith(first):
        raise ValueError("an output without its first mark")
    one, mark, rest = output[len(first):].partition(second)
    other, last, middle = rest.partition(m)
    if not mark or not last:
        raise ValueError("an output without its marks")
    return one + middle + other if form == "psm" else other + middle + one


def fill_middle(df: DataFrame, doc: str = "doc_id", text: str = "text", unit: str = "point", seed: int = 1,
                rate: int = 90, spm: int = 20, output: bool = False) -> DataFrame:
    """Cut each row's whole text at two places and move the middle to the end.

    Of a text of ``n`` units the prefix ends after the smaller, the middle
    after the larger of two numbers modulo ``n + 1`` taken from the SHA-256 of
    ``seed:doc``. ``rate`` percent of the rows are transformed, ``spm`` percent
    of these with the suffix first; an empty text and one that holds a mark
    stay plain. Adds ``n``, ``form`` (plain, psm, spm), ``prefix_chars``,
    ``middle_chars`` (code points, null if plain), ``output_sha256``,
    ``restored_sha256`` (of the text rebuilt from output and form) and, with
    ``output``, the output itself. Null text counts as empty, a null id is
    written as nothing. Rows stay one to one, repeated rows get equal results;
    columns of these names are replaced; an empty table stays empty.
    """
    on_workers(df.sparkSession)
    made = MADE | ({"output": "string"} if output else {})

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for ids, column in batches:
            raw, off = ta.utf8(column)
            rows = []
            for k, name in enumerate(ids.to_pylist()):
                own = raw[off[k]: off[k + 1]]
                out, n, form, before, inside = transform(own.tobytes(), own, numbers(seed, name), unit, rate, spm)
                back = restore(out, form)
                rows.append((n, form, before, inside, hashlib.sha256(out).hexdigest(), hashlib.sha256(back).hexdigest(), out.decode() if output else None))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()][: len(made)]
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], list(made))

    struct = "struct<" + ",".join(f"{k}:{t}" for k, t in made.items()) + ">"
    cut = F.arrow_udf(run, struct, ArrowUDFType.SCALAR_ITER)(F.col(doc).cast("long"), F.col(text))
    inner = fresh_name(df, "cut")
    keep = [f"`{c}`" for c in df.columns if c.lower() not in made]
    return df.withColumn(inner, cut).select(*keep, *[F.col(f"{inner}.{c}") for c in made])
