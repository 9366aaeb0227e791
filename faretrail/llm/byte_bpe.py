"""Operator 7: byte-level BPE by recursive queries.

Each task cuts its texts with the tokenizer's pattern and hands the distinct
words it has not met to an in-process DuckDB: one row a byte (token, position),
joined to the merge table; a recursive query contracts each word's leftmost
pair of least rank until no pair of the word is in the table. Decoding is an
ordered aggregation of the tokens' bytes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType

from faretrail.llm import textarrays as ta
from faretrail.llm.common import fresh_name, on_workers, own_state, released

#: Bytes of text that are cut into words at a time.
GROUP = 2 << 20
#: Words in one recursive query; they come in the order of their lengths, so that short ones do not wait for long ones.
WORDS = 10_000
#: Longer words (in bytes) take one contraction after another from a heap, as a recursion over them would not end soon.
LONG_WORD = 200
#: Entries after which the cache turns into the old one, which the next turn drops; results do not depend on it.
KEPT = 300_000

# A word's rows leave the recursion in the turn that finds no pair for it; words come in as live rows.
ENCODE = """
WITH RECURSIVE step(word, pos, token, live) AS (
    SELECT word, pos, token, live FROM bytes_in
  UNION ALL
    SELECT word, pos, CASE WHEN pos = best & 4294967295 THEN (best >> 32)::INTEGER ELSE token END, best IS NOT NULL
    FROM (SELECT word, pos, token, before, min((rank::BIGINT << 32) + pos) OVER (PARTITION BY word) AS best
          FROM (SELECT word, pos, token, lead(token) OVER w AS following, lag(pos) OVER w AS before
                FROM step WHERE live WINDOW w AS (PARTITION BY word ORDER BY pos)) p
          LEFT JOIN merges m ON m.l = p.token AND m.r = p.following)
    WHERE best IS NULL OR before IS DISTINCT FROM best & 4294967295
)
"""
IDS = ENCODE + "SELECT word, list(token ORDER BY pos) AS ids FROM step WHERE NOT live GROUP BY word"
#: The ids of each word as text, their number, and the bytes they stand for: decoding is the ordered aggregation of the ids' pieces.
ROUND_TRIP = ENCODE + """
SELECT word, string_agg(token, ',' ORDER BY pos) AS ids, count(*) AS n, string_agg(piece, '' ORDER BY pos) AS bytes
FROM step JOIN pieces USING (token) WHERE NOT live GROUP BY word ORDER BY word
"""

DECODE = """
SELECT word, string_agg(piece, '' ORDER BY pos) AS bytes
FROM ids_in JOIN pieces USING (token) GROUP BY word
"""

def coder(path: str, pattern: str) -> Coder:
    """One coder a process and vocabulary, so that tasks of one worker share the cache."""
    held = own_state("byte_bpe")
    if (path, pattern) not in held:
        held[path, pattern] = Coder(path, pattern)
    return held[path, pattern]


class Coder:
    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        self.pattern = regex.compile(pattern)
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.byte = np.array([self.ranks[bytes([k])] for k in range(256)], np.int32)
        pairs = [(self.ranks[t[:k]], self.ranks[t[k:]], r) for t, r in self.ranks.items()
                 for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for t, r in self.ranks.items():
            self.tokens[r] = t
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "256MB"})
        l, r, rank = (pa.array(x, pa.int32()) for x in zip(*pairs, strict=True))
        self._load("merges", pa.table({"l": l, "r": r, "rank": rank}))
        # bytes as text of one character a byte, so that they can be put together in order
        self._load("pieces", pa.table({"token": pa.array(self.ranks.values(), pa.int32()),
                                       "piece": [t.decode("latin-1") for t in self.ranks]}))
        # of a word its ids, a blank and the decoded bytes: one object takes half the memory of several
        self.kept: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _load(self, name: str, rows: pa.Table) -> None:
        self.db.register("given", rows)
        self.db.execute(f"CREATE TABLE {name} AS FROM given")
        self.db.unregister("given")

    def _query(self, sql: str, name: str, rows: pa.Table) -> pa.Table:
        self.db.register(name, rows)
        out = self.db.sql(sql).to_arrow_table()
        self.db.unregister(name)
        return out

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word; a word that is itself a token is that token."""
        out: list[list[int] | None] = [[self.ranks[w]] if w in self.ranks else None for w in words]
        rest = [k for k, x in enumerate(out) if x is None]
        for k in rest:
            if len(words[k]) > LONG_WORD:
                out[k] = self._long(words[k])
        rest = [k for k in rest if out[k] is None]
        for i in range(0, len(rest), WORDS):
            part = rest[i: i + WORDS]
            found = self._query(IDS, "bytes_in", self._rows([words[k] for k in part], [None] * len(part)))
            for w, ids in zip(found.column("word").to_pylist(), found.column("ids").to_pylist(), strict=True):
                out[part[w]] = ids
        return out

    def _rows(self, words: list[bytes], done: list[list[int] | None]) -> pa.Table:
        """A live row a byte of each word, or a finished row a token of those whose ids are given."""
        tokens = [self.byte[np.frombuffer(w, np.uint8)] if ids is None else ids for w, ids in zip(words, done, strict=True)]
        size = np.array([len(x) for x in tokens], np.int64)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return pa.table({"word": np.repeat(np.arange(len(words), dtype=np.int32), size), "pos": at.astype(np.int32),
                         "token": np.concatenate([*tokens, []]).astype(np.int32), "live": np.repeat([x is None for x in done], size)})

    def _rank(self, a: int, b: int) -> int | None:
        """The token that two neighbours make, if any."""
        return self.ranks.get(self.tokens[a] + self.tokens[b])

    def _long(self, word: bytes) -> list[int]:
        """The same contraction for one long word: a heap of (rank, position) over linked positions."""
        token = [int(self.byte[b]) for b in word]
        n = len(token)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := self._rank(token[i], token[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if token[i] < 0 or j >= n or self._rank(token[i], token[j]) != rank:
                continue
            token[i], token[j], after[i] = rank, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := self._rank(token[a], token[b])) is not None:
                    heapq.heappush(heap, (r, a))
        return [t for t in token if t >= 0]

    def decode(self, ids: list[list[int]]) -> list[bytes]:
        """The bytes of each list of ids, by ordered aggregation; an id that is no token raises ``ValueError``."""
        out = [b""] * len(ids)
        for i in range(0, len(ids), WORDS):
            part = ids[i: i + WORDS]
            size = np.array([len(x) for x in part])
            word = np.repeat(np.arange(len(part), dtype=np.int32), size)
            at = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
            token = np.fromiter((t for x in part for t in x), np.int32, len(word))
            if len(token) and (token.min() < 0 or token.max() >= len(self.ranks)):
                raise ValueError("an id that is not in the vocabulary")
            got = self._query(DECODE, "ids_in", pa.table({"word": word, "pos": at.astype(np.int32), "token": token}))
            for w, text in zip(got.column("word").to_pylist(), got.column("bytes").to_pylist(), strict=True):
                out[i + w] = text.encode("latin-1")
        return out

    def _learn(self, words: list[str]) -> None:
        words = sorted(words, key=len)
        for i in range(0, len(words), WORDS):
            part = words[i: i + WORDS]
            raw = [w.encode() for w in part]
            done = [[self.ranks[w]] if w in self.ranks else self._long(w) if len(w) > LONG_WORD else None for w in raw]
            got = self._query(ROUND_TRIP, "bytes_in", self._rows(raw, done))
            found = zip(got.column("ids").to_pylist(), got.column("bytes").to_pylist(), strict=True)
            self.kept.update(zip(part, [f"{ids} {text}".encode("latin-1") for ids, text in found], strict=True))

    def _looked_up(self, words: list[str]) -> list[tuple[bytes, bytes]]:
        """Of distinct words the ids, a comma after each, and the decoded bytes."""
        kept, old = self.kept, self.old
        unknown = list(filterfalse(kept.__contains__, words))
        if unknown:
            kept.update({w: old[w] for w in unknown if w in old})
            self._learn(list(filterfalse(old.__contains__, unknown)))
        found = [kept[w].partition(b" ") for w in words]
        if len(kept) > KEPT:
            self.kept, self.old = {}, kept
        return [(ids + b",", raw) for ids, _, raw in found]

    def texts(self, texts: Iterable[str | None]) -> Iterator[tuple[bytes, int, bytes]]:
        """Of each text (null: empty) the ids joined by commas, their number and the decoded bytes."""
        group, size = [], 0
        for t in texts:
            if t and len(t) > 2 * GROUP:  # a very long text: its words in turn
                yield from self._group(group)
                group, size = [], 0
                yield self._very_long(t)
                continue
            group.append(self.pattern.findall(t or ""))
            size += len(t or "")
            if size >= GROUP:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, group: list[list[str]]) -> Iterator[tuple[bytes, int, bytes]]:
        words = pa.array(list(chain.from_iterable(group)), pa.large_string()).dictionary_encode()
        found = self._looked_up(words.dictionary.to_pylist())
        ends = np.cumsum([0, *map(len, group)])
        ids, raws = (_in_order([x[k] for x in found], words.indices, ends) for k in (0, 1))
        for joined, raw in zip(ids, raws, strict=True):
            yield joined[:-1], joined.count(b","), raw

    def _very_long(self, text: str) -> tuple[bytes, int, bytes]:
        parts, words, size = [], [], 0
        for m in self.pattern.finditer(text):
            words.append(m[0])
            size += len(m[0])
            if size >= GROUP:
                parts += self._group([words])
                words, size = [], 0
        parts += self._group([words])
        ids, n, raw = zip(*[p for p in parts if p[1]])
        return b",".join(ids), sum(n), b"".join(raw)


def _in_order(values: list[bytes], which: pa.Array, ends: np.ndarray) -> Iterator[bytes]:
    """The values that ``which`` names, put together for each text; its words end at ``ends``."""
    taken = pa.array(values, pa.large_binary()).take(which)
    _, at, data = taken.buffers()
    at = np.frombuffer(at, np.int64, len(taken) + 1)[ends].tolist() if len(taken) else [0] * len(ends)
    for a, z in zip(at, at[1:]):
        yield data[a:z].to_pybytes() if z > a else b""


def encode(df: DataFrame, ranks: str, pattern: str, text: str = "text", ids: bool = False) -> DataFrame:
    """Encode each row's whole text, decode the ids, and add the results.

    ``ranks`` is a rank file (one ``base64 rank`` a line) on every executor
    under the same path, ``pattern`` the expression that cuts texts into words.
    Adds ``n_tokens`` (long), ``ids_sha256`` (of the decimal ids joined by
    commas), ``decoded_sha256`` (of the decoded bytes) and, with ``ids``,
    ``ids`` (array of int) and ``decoded`` (string). Null text counts as empty.
    Rows stay one to one, repeated rows too; columns of these names are
    replaced, an empty table stays empty. Texts over 4 MB are handled a piece of
    words at a time, words over 200 bytes by a heap with the same result.
    """
    on_workers(df.sparkSession)
    made = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * ids

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        code = coder(ranks, pattern)
        for column in batches:
            n, a, b, tokens, raws = [], [], [], [], []
            _, off = ta.utf8(column)
            for i, j in ta.blocks(off, GROUP):
                for joined, count, raw in code.texts(column.slice(i, j - i).to_pylist()):
                    n.append(count)
                    a.append(hashlib.sha256(joined).hexdigest())
                    b.append(hashlib.sha256(raw).hexdigest())
                    if ids:
                        tokens.append(np.fromstring(joined.decode(), np.int32, sep=",") if joined else np.zeros(0, np.int32))
                        raws.append(raw.decode())
            out = [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            names = ["n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                out += [pa.array(tokens, pa.list_(pa.int32())), pa.array(raws, pa.string())]
                names += ["ids", "decoded"]
            yield pa.StructArray.from_arrays(out, names)
        released()

    kinds = made.replace(" long", ":bigint").replace(" string", ":string").replace(" array", ":array")
    coded = F.arrow_udf(run, f"struct<{kinds}>", ArrowUDFType.SCALAR_ITER)(F.col(text))
    names = [x.split()[0] for x in made.split(", ")]
    keep = [f"`{c}`" for c in df.columns if c.lower() not in names]
    inner = fresh_name(df, "coded")
    return df.withColumn(inner, coded).select(*keep, *[F.col(f"{inner}.{n}") for n in names])
