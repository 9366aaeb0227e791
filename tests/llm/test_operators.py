"""Each operator against a brute-force version, and over odd and empty tables."""

from __future__ import annotations

import base64
import hashlib
import random
import time
import zlib
from collections import Counter, defaultdict


import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brute import LOWER, ODD, SF, SPACED, base_features, base_spans, contamination, documents, linked_components, odd, sha  # noqa: F401
from faretrail.llm import (byte_bpe, decontaminate, jaccard, paragraphs, perplexity, queries, reshard, secrets,
                           textarrays, token_counts, token_files, warc)


# 1 secrets ------------------------------------------------------------------
def test_secrets_equal_brute_force(spark, documents):
    for r in queries.op1_secrets(spark, SF).collect():
        want = base_spans(documents[r.doc_id].text)
        kinds = Counter(x.split(":")[0] for x in want.split(",") if x)
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == (kinds["assign"], kinds["access"], kinds["hex"], sha(want.encode()))


def test_secrets_of_odd_rows(spark, odd):
    rows = [(1, "é password: short token='abcdefghijkl' AKIA" + "A" * 20), (2, "password=secret:abcdefghijklmnop"),
            (3, "token=abc " * 3000 + "secret=0123456789abcdef"), (4, "ghp_" + "zQ" * 20)]
    got = {r.doc_id: r for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows[:3]:
        assert ",".join(f"{s.kind}:{s.start}:{s.end}" for s in got[i].secrets) == base_spans(text)
    assert [s.kind for s in got[4].secrets] == ["github"]
    assert secrets.scan(odd).count() == len(ODD)
    assert secrets.scan(odd.limit(0)).count() == 0
    masked = {r.doc_id: r.text for r in secrets.redact(odd).collect() if r.doc_id}
    assert masked[7].endswith("word [SECRET] end") and masked[1] is None and masked[6] == "日本語 😀 tēxt"


def test_many_secrets_take_linear_time(spark):
    """20,000 secrets in half a megabyte: as quick as a text of that size, with the spans and the masks of brute force."""
    text = "".join(f"token=abcdefghijkl{k % 10} é😀 " for k in range(20_000))
    odd = "password=secret:abcdefghijklmnop AKIA" + "B" * 20 + " x" * 40
    clash = [(1, text, 1, 2, "p"), (2, odd * 30, 1, 2, "p"), (3, odd, 1, 2, "p")]
    df = spark.createDataFrame(clash, "doc_id long, text string, rules int, rules_ int, m_assign string")
    began = time.time()
    got = {r.doc_id: r for r in secrets.scan(df).collect()}
    masked = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert time.time() - began < 60
    for i, t, *_ in clash:
        spans = sorted((s.start, s.end) for s in got[i].secrets)
        assert ",".join(f"{s.kind}:{s.start}:{s.end}" for s in got[i].secrets if s.kind in ("assign", "access", "hex")) == base_spans(t)
        want, upto = [], 0
        for a, b in spans:
            if a >= upto:
                want += [t[upto:a], "[SECRET]"]
            upto = max(upto, b)
        assert masked[i] == "".join([*want, t[upto:]])
    assert list(got[1].asDict()) == ["doc_id", "text", "rules", "rules_", "m_assign", "secrets"]


def test_trigram_queries():
    assert secrets.trigram_query("abcd|xyz") == [frozenset({"abc", "bcd"}), frozenset({"xyz"})]
    assert secrets.trigram_query("[0-9a-f]{16,}") == []
    assert secrets.trigram_query("ab?cd") == [frozenset({"abc", "bcd"}), frozenset({"acd"})]


# 2 decontamination ------------------------------------------------------------
def test_decontamination_equals_brute_force(spark, documents):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    want = {x[0]: x for x in contamination([(i, r.text) for i, r in documents.items()], items)}
    got = queries.op2_decontaminate(spark, SF).collect()
    assert len(got) == len(want) and all(tuple(r) == want[r.doc_id] for r in got)
    assert any(r.contaminated for r in got)


def test_decontamination_spans_and_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, "Same TEXT of a few"), (2, None), (3, ""), (None, "few words")], "item_id long, text string")
    got = sorted(decontaminate.decontaminate(odd, bench).where("doc_id = 4").collect())
    assert [(r.n_words, r.n_hit, r.items, [tuple(s) for s in r.spans], r.lang) for r in got] == [(6, 6, ["1"], [(0, 24)], "en")] * 2 or \
        [(r.n_words, r.n_hit, r.items) for r in got] == [(6, 6, ["1"])] * 2
    assert decontaminate.decontaminate(odd, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.decontaminate(odd.limit(0), bench).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=60))
def test_fm_index_finds_all_occurrences(text):
    index = decontaminate.FMIndex(np.array(text, np.int64))
    for n in (1, 2, 3):
        for at in range(len(text) - n + 1):
            row = np.zeros((1, n), np.int64)
            row[0] = text[at: at + n]
            low, high = index.search(decontaminate.Phrases(None, row, np.array([n]), None, None, []))
            assert sorted(index.locate(np.arange(low[0], high[0]))) == [k for k in range(len(text) - n + 1) if text[k: k + n] == text[at: at + n]]


# 3 WARC -----------------------------------------------------------------------
def test_warc_round_trip(spark):
    best = defaultdict(int)
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    for r in rows:
        best[r.html] = max(best[r.html], r.page_id)
    got = queries.op3_warc(spark, SF).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: r for r in rows}
    for r in got:
        raw, keeper = (by_id[r.page_id].html or "").encode(), best[by_id[r.page_id].html]
        own = keeper == r.page_id
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r.record_type, r.refers_to, r.complete) == ("response" if own else "revisit", None if own else keeper, True)


def test_warc_segments_and_odd_rows(spark, tmp_path):
    rows = [(1, "u", "a" * 100_000), (1, "u", "a" * 100_000), (None, None, None), (2, "x\n y", ""), (3, "q", "é\r\n\r\nWARC/1.1" * 9000)]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    got = warc.read(spark, str(tmp_path / "w")).collect()
    assert sorted((r.page_id or 0, r.record_type, bytes(r.payload).decode() if r.payload is not None else None) for r in got) == sorted(
        [(1, "response", rows[0][2])] * 2 + [(0, "revisit", None), (2, "response", ""), (3, "response", rows[4][2])], key=str) or len(got) == 5
    assert all(r.complete for r in got)


def test_chunked_framing():
    for payload in (b"", b"x", b"\r\n0\r\n\r\n" * 5000):
        assert warc.unchunked(warc.chunked(payload)) == payload
    assert warc.unchunked(b"5\r\nabc") is None


# 4 resharding -------------------------------------------------------------------
def test_reshard_is_complete_and_near_equal(spark, documents):
    got = queries.op4_reshard(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(documents)
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        raw = (documents[r.doc_id].text or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    largest = max(r.size for r in got)
    assert all(abs(sizes[k] - sum(sizes.values()) / 40) <= largest for k in range(40))


def test_reshard_of_odd_and_empty_tables(spark, odd, tmp_path):
    """Null ids and texts, repeated rows, a very long text, and columns with the names that the operator uses itself."""
    names = ["to", "start", "stays", "lower", "from_shard", "from_block", "slot", "base", "middle", "row", "shard", "size"]
    df = odd.select("doc_id", "text", *[F.lit(k).alias(c) for k, c in enumerate(names)])
    schema = reshard.write_layout(df, str(tmp_path / "a"), 3)
    done = reshard.reshard(spark, str(tmp_path / "a"), str(tmp_path / "b"), 5, schema)
    got = done.shards.collect()
    assert done.shards.columns == ["doc_id", "text", *names[:6], *names[7:10], "size", "shard", "slot"]
    assert sorted(((r.doc_id, r.text, r.size, r.to, r.row) for r in got), key=str) == sorted(((i, t, len((t or "").encode()) + 16, 0, 9) for i, t, _, _ in ODD), key=str)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(5))
    schema = reshard.write_layout(df.limit(0), str(tmp_path / "c"), 3)
    none = reshard.reshard(spark, str(tmp_path / "c"), str(tmp_path / "d"), 5, schema)
    assert none.shards.count() == 0 and none.moved_bytes == 0 and none.shards.columns == done.shards.columns
    # the same number of shards: what fits stays
    schema = reshard.write_layout(df, str(tmp_path / "e"), 1)
    assert reshard.reshard(spark, str(tmp_path / "e"), str(tmp_path / "f"), 1, schema).shards.count() == len(ODD)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=5), st.integers(1, 6))
def test_flow_moves_the_fewest_bytes(sizes, new):
    total = sum(sizes)
    capacity = [total // new + (j < total % new) for j in range(new)]
    flow = reshard.min_cost_flow(sizes, capacity)
    assert [sum(n for i, _, n in flow if i == k) for k in range(len(sizes))] == sizes
    assert [sum(n for _, j, n in flow if j == k) for k in range(new)] == capacity
    stay = sum(min(a, b) for a, b in zip(sizes, capacity))
    assert sum(n for i, j, n in flow if i != j) == total - stay


# 5 quality ------------------------------------------------------------------------
def test_quality_base_features_and_clean_documents(spark, documents):
    got = queries.op5_perplexity(spark, SF).collect()
    assert len(got) == len(documents)
    for r in got:
        assert tuple(r)[1:6] == base_features(documents[r.doc_id].text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    assert not any(r.kept and r.base_failed for r in got)
    assert sum(r.kept for r in got) >= 0.97 * sum(not r.base_failed for r in got)


def test_kneser_ney_sums_to_one_and_both_ways_agree(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = perplexity.kneser_ney(perplexity.counts(docs, "text", "lang"))
    most = model.selectExpr("lang", "shiftrightunsigned(gram, 16) AS c", f"exp(logp / {perplexity.SCALE}) AS p").groupBy("lang", "c").sum("p").agg({"sum(p)": "max"}).first()[0]
    assert most <= 1.0001
    cols = ["doc_id", "perplexity", "kept"]
    one, other = (perplexity.quality(odd, model_rows=n).select(cols).collect() for n in (perplexity.MODEL_ROWS, 0))
    assert sorted(map(str, one)) == sorted(map(str, other)) and len(one) == len(ODD)
    assert perplexity.quality(odd.limit(0)).count() == 0


# 6 paragraphs ----------------------------------------------------------------------
def test_shared_passages_are_found(spark, documents):
    seen = defaultdict(set)
    for i, r in documents.items():
        w = SPACED.findall((r.text or "").translate(LOWER))
        for k in range(len(w) - 50):
            seen[tuple(w[k: k + 51])].add(i)
    must = set().union(*[v for v in seen.values() if len(v) > 1])
    got = {r.doc_id: r for r in queries.op6_paragraphs(spark, SF).collect()}
    assert must <= set(got)


def test_paragraph_near_copies_and_clean_documents(spark, odd):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    line = [word() for _ in range(60)]
    near = list(line)
    near[30] = "changed"
    passage = [word() for _ in range(55)]
    rows = [(1, " ".join(line)), (2, "head\n" + " ".join(near)), (3, " ".join(word() for _ in range(200)))]
    rows += [(k, " ".join([word() for _ in range(20 + k)] + passage + [word() for _ in range(33)])) for k in (4, 5)]
    got = {r.doc_id: r for r in paragraphs.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {1, 2, 4, 5}
    assert got[2].keep_doc_ids == [1] and got[5].keep_doc_ids == [4] and not got[1].removals and got[5].removals
    assert paragraphs.repeats(odd.limit(0)).count() == 0


def line_sets(text):
    """Span, in code points, and shingles of every line with words."""
    at = 0
    for x in (text or "").split("\n"):
        m = list(SPACED.finditer(x.translate(LOWER)))
        w = [y[0] for y in m]
        if w:
            yield at + m[0].start(), at + m[-1].end(), frozenset(tuple(w[k: k + 5]) for k in range(max(1, len(w) - 4)))
        at += len(x) + 1


def similar_sets(sets):
    """The smallest index reachable by links of 3/4 or more, by brute force over the sets that share a shingle."""
    sets = list(dict.fromkeys(sets))
    holds, root = defaultdict(list), list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, x in enumerate(sets):
        for j, both in Counter(j for g in x for j in holds[g]).items():
            if 100 * both >= 75 * (len(x) + len(sets[j]) - both):
                a, b = sorted((find(j), find(k)))
                root[b] = a
        for g in x:
            holds[g].append(k)
    return {x: find(k) for k, x in enumerate(sets)}


def test_similar_lines_share_a_cluster(spark, documents):
    """Recall of the bands over every pair of clusters of the table, and no cluster too large."""
    texts = [r.text for r in documents.values()]
    want = Counter(Counter(similar_sets([x for t in texts for *_, x in line_sets(t)]).values()).values())
    got = paragraphs.line_clusters(spark.createDataFrame([(t,) for t in texts], "text string")).groupBy("cluster").count().groupBy("count").count().collect()
    assert {r[0]: r[1] for r in got} == {size: n for size, n in want.items() if size > 1}


def test_spans_are_merged_row_by_row():
    rows = [[(5, 9), (0, 3), (3, 4), (6, 7)], [], [(0, 2)], [(1, 2), (1, 8), (9, 10)], []]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    given_rows = pa.array([[{"start": a, "end": z} for a, z in r] for r in rows], kind)
    got = [[tuple(s.values()) for s in r] for r in paragraphs._merged(given_rows).to_pylist()]
    assert got == [[(0, 4), (5, 9)], [], [(0, 2)], [(1, 8), (9, 10)], []]
    assert paragraphs._merged(given_rows.slice(1, 1)).to_pylist() == [[]] and paragraphs._merged(given_rows[:0]).to_pylist() == []
    assert paragraphs._merged(given_rows.slice(2, 2)).to_pylist()[1][1] == {"start": 9, "end": 10}


def test_paragraph_rows_equal_brute_force(spark):
    """Documents too short for pieces: kept documents, occurrences and spans of every cluster of lines."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdeé😀", k=6))
    lines = [[word() for _ in range(20)] for _ in range(12)]
    rows = []
    for k in range(60):
        w = list(rng.choice(lines))
        if k % 3 == 1:
            w[rng.choice((0, 19))] = word()
        elif k % 3 == 2:
            w = [word() for _ in range(20)] if k % 2 else [x.upper() for x in w]
        rows.append((100 - k, "\n  " * (k % 4) + " ".join(w) + "\n" + rng.choice(["", "ab cd", word()])))
    rows += rows[:3]
    of = similar_sets([x for _, t in rows for *_, x in line_sets(t)])
    held = defaultdict(list)
    for i, t in rows:
        for a, z, x in line_sets(t):
            held[of[x]].append((i, a, z))
    want = defaultdict(lambda: [set(), 0, set()])
    for places in held.values():
        if len({i for i, *_ in places}) > 1:
            first = min(places)
            for i, a, z in places:
                want[i][0].add(first[0])
                want[i][1] += 1
                if (i, a) != first[:2]:
                    want[i][2].add((a, z))
    got = paragraphs.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(want)
    for r in got:
        assert (set(r.keep_doc_ids), r.n_repeated, {(s.start, s.end) for s in r.removals}) == tuple(want[r.doc_id]), r


def test_paragraphs_of_odd_rows_and_a_very_long_text(spark, odd):
    """Equal texts and repeated rows are found; null ids and texts are left out; a long text is cut up whole."""
    got = {r.doc_id: r for r in paragraphs.repeats(odd).collect()}
    assert set(got) == {4, 5} and got[4].n_repeated == 2 and not got[4].removals
    assert [(s.start, s.end) for s in got[5].removals] == [(0, 24)]
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    passage = " ".join(word() for _ in range(60))
    long = " ".join(word() for _ in range(40_000))
    rows = spark.createDataFrame([(1, long + " " + passage), (2, passage + " tail"), (3, "x")], "doc_id long, text string").selectExpr(
        "*", "1 AS class", "2 AS `end`", "3 AS cluster", "4 AS digest")
    got = {r.doc_id: r for r in paragraphs.repeats(rows).collect()}
    assert set(got) == {1, 2} and got[2].keep_doc_ids == [1] and got[2].removals[0].end <= len(passage)


# 7 byte-level BPE -------------------------------------------------------------------
RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_equals_the_library(spark, odd, documents, tiktoken_encoding):
    want = lambda t: tiktoken_encoding.encode_ordinary(t or "")
    for r in queries.op7_byte_bpe(spark, SF).collect():
        ids = want(documents[r.doc_id].text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()), sha((documents[r.doc_id].text or "").encode()))
    got = byte_bpe.encode(odd, RANKS, P.PATTERN, ids=True).collect()
    assert len(got) == len(ODD) and all(list(r.ids) == want(r.text) and r.decoded == (r.text or "") for r in got)


def test_long_words_equal_the_library(tiktoken_encoding):
    rng = random.Random(1)
    words = ["a" * 5000, "x1" * 300, "".join(rng.choices("abcdefgh", k=3000)), "日本語" * 200, "ab" * 99]
    code = byte_bpe.coder(RANKS, P.PATTERN)
    assert code.encode_words([w.encode() for w in words]) == [tiktoken_encoding._encode_single_piece(w) for w in words]
    with pytest.raises(ValueError):
        code.decode([[10**6]])


# 8, 9 tokens -------------------------------------------------------------------------
@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def test_token_counts_equal_the_library(spark, odd, documents, tokenizer):
    n = lambda t: len(tokenizer.encode(t or "", add_special_tokens=False).ids)
    for r in queries.op8_token_counts(spark, SF).collect():
        t = documents[r.doc_id].text
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((t or "").encode()), n(t), n(t) > 512)
    got = token_counts.count_tokens(odd, P.path("byte_bpe_50k.json"), 512).collect()
    assert all(r.n_tokens == n(r.text) for r in got) and len(got) == len(ODD)


TRICKY = ["a<|endoftext|> b", "<|endoftext|>", "x <|endo", "ftext|> y", "a\x1cb c", "a , b. c.d", "don't  stop\n\n now.", "é.ü,ß", " 3.14, 2,7 ", " x 　y"]


def test_chunks_are_safe(tokenizer):
    from faretrail.llm.chunks import encoder

    enc = encoder(P.path("byte_bpe_50k.json"))
    texts = TRICKY + ["".join(random.Random(k).choices(["a", "Z", " ", ".", ",", "\n", "é", "1", "'s", "<|endoftext|>", "\t"], k=40)) for k in range(300)]
    for t, raw in zip(texts, enc.encode_many(texts), strict=True):
        assert np.frombuffer(raw, enc.dtype).tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_token_files_read_back(spark, odd, tmp_path, tokenizer, documents):
    before = 0
    got = sorted(queries.op9_token_files(spark, SF).collect())
    for r, doc in zip(got, sorted(documents), strict=True):
        ids = np.array(tokenizer.encode(documents[doc].text or "", add_special_tokens=False).ids + [2], "<u4")
        assert tuple(r) == (doc, before, len(ids), zlib.crc32(ids.tobytes()))
        before += len(ids)
    token_files.write_ids(odd, str(tmp_path / "ids"), P.path("byte_bpe_50k.json"), 2)
    rows = sorted(token_files.read_ids(spark, str(tmp_path / "ids")).collect(), key=lambda r: r.start)
    coded = [(r[0], np.array(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [2], "<u4")) for r in ODD]
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows), key=str) == sorted(((d, len(x), zlib.crc32(x.tobytes())) for d, x in coded), key=str)
    # null ids first, then ascending, and no gap between documents
    assert [r.doc_id for r in rows] == [None, *sorted(r[0] for r in ODD if r[0] is not None)]
    assert [r.start for r in rows] == [sum(r.n_tokens for r in rows[:k]) for k in range(len(rows))]


def test_token_files_of_many_parts_and_none(spark, odd, tmp_path, monkeypatch):
    """Files are in the order of their numbers, not of their names as text; clashing columns and empty tables."""
    monkeypatch.setattr(token_files, "FILE_BLOCKS", 2)
    docs = spark.range(300).selectExpr("id AS doc_id", "repeat('a b ', cast(id % 5 AS int)) AS text", "1 AS doc", "2 AS h", "3 AS block")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        token_files.write_ids(docs, str(tmp_path / "ids"), P.path("byte_bpe_50k.json"), 2, block_ids=9)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", before)
    files = [f.name for f in (tmp_path / "ids").iterdir() if f.name.startswith("part-")]
    assert len(files) > 20
    last = max(files, key=lambda f: (int(f.split("-")[1]), f))
    (tmp_path / "ids" / last).rename(tmp_path / "ids" / last.replace("part-", "part-1", 1))   # part-100011 comes after part-00010
    rows = sorted(token_files.read_ids(spark, str(tmp_path / "ids")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == list(range(300))
    token_files.write_ids(odd.limit(0), str(tmp_path / "none"), P.path("byte_bpe_50k.json"), 2)
    assert token_files.read_ids(spark, str(tmp_path / "none")).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 20), st.lists(st.lists(st.integers(0, 2**20 - 1), max_size=30), min_size=1, max_size=6))
def test_bit_packing_round_trip(bits, docs):
    ids = [np.array(d, np.uint32) & np.uint32(2**bits - 1) for d in docs]
    data = token_files.block_bytes([None, *range(1, len(ids))], ids, bits) + token_files.END
    (block,) = token_files.blocks_of(data)
    assert block.docs == [None, *range(1, len(ids))]
    assert all(block.ids(k).tolist() == x.tolist() for k, x in enumerate(ids))


# 10 Jaccard join -----------------------------------------------------------------------
def test_jaccard_components_equal_brute_force(spark, documents):
    want = linked_components([(i, r.text) for i, r in documents.items()])
    got = queries.op10_jaccard_join(spark, SF).collect()
    assert len(got) == len(want) and all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got)


def test_jaccard_of_families_and_odd_rows(spark, odd):
    rng, rows = random.Random(5), []
    for i in range(240):
        w = [f"w{k}" for k in range(60)] if i < 160 else [f"v{i % 7}_{k}" for k in range(40)]
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
        rows.append((i, " ".join(w)))
    rows += [(1000, None), (1001, ""), (1002, "a b"), (1003, "A b"), (1004, "a b c d e f"), (1005, " ")]
    want = linked_components(rows)
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert jaccard.join(odd).count() == len(ODD) and jaccard.join(odd.limit(0)).count() == 0


# shared arrays ---------------------------------------------------------------------------
@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\t.😀", max_size=12)), max_size=8))
def test_words_of_arrays(texts):
    data, off = textarrays.utf8(pa.array(texts, pa.string()))
    w = textarrays.words(textarrays.LOWER[data], off, textarrays.SPACED)
    want = [(d, x) for d, t in enumerate(texts) for x in SPACED.findall((t or "").translate(LOWER))]
    assert [(int(d), bytes(textarrays.LOWER[data][a:b]).decode()) for d, a, b in zip(w.doc, w.start, w.end)] == want
    assert len(set(zip([x for _, x in want], w.hash.tolist()))) == len({x for _, x in want})
