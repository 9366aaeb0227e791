"""What the findings of round 3 asked for."""

from __future__ import annotations

import gc
import random
import weakref

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from tokenizers import Tokenizer

from faretrail.llm import byte_bpe, chunks, jaccard, paragraphs

SPACES = ["\t", "\n", "\r", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", " ", " ", " ", " ", " ", "　", "​"]


def test_a_chunk_is_looked_up_once_a_group(monkeypatch):
    enc, asked = chunks.ChunkEncoder(P.path("byte_bpe_50k.json")), []
    ids = enc._ids
    monkeypatch.setattr(enc, "_ids", lambda c: asked.append(c) or ids(c))
    got = list(enc.encode_many(pa.array(["the cat and the dog, the cat."] * 50 + [None, ""])))
    assert [len(c) for c in asked] == [len(set(asked[0]))]
    assert len(set(got[:50])) == 1 and got[50:] == [b"", b""]


def test_chunks_of_columns_and_long_texts_equal_the_library(monkeypatch):
    tokenizer, r = Tokenizer.from_file(P.path("byte_bpe_50k.json")), random.Random(3)
    parts = ["a", "B", "1", ".", ",", " ", "  ", "é", "я", "字", "_", "'s", "!", "<|endoftext|>", "́", "½", "🙂", *SPACES]
    texts = ["".join(r.choices(parts, k=r.randrange(20))) for _ in range(2000)]
    for piece in (16, 4096):
        monkeypatch.setattr(chunks, "PIECE", piece)
        enc = chunks.ChunkEncoder(P.path("byte_bpe_50k.json"))
        for given in (texts, pa.array(["", *texts])[1:], pa.chunked_array([texts[:7], texts[7:]])):
            for t, raw in zip(texts, enc.encode_many(given), strict=True):
                assert pa.array(tokenizer.encode(t, add_special_tokens=False).ids, pa.uint16()).to_pylist() == memoryview(raw).cast("H").tolist(), t


def test_a_worker_keeps_the_state_of_one_operator():
    code = byte_bpe.coder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    assert byte_bpe.coder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN) is code
    kept = weakref.ref(code)
    del code
    chunks.encoder(P.path("byte_bpe_50k.json"))
    gc.collect()
    assert kept() is None


def test_byte_bpe_keeps_one_small_object_a_word(monkeypatch):
    texts = ["the cat and the dog, the cat. " * 9, None, "", "é字🙂 " + "ab" * 500, "x " * 3000]
    ranks = byte_bpe.Coder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    want = [[k for w in ranks.pattern.findall(t or "") for k in ranks.encode_words([w.encode()])[0]] for t in texts]
    for group, kept in ((byte_bpe.GROUP, byte_bpe.KEPT), (64, 3)):
        monkeypatch.setattr(byte_bpe, "GROUP", group)
        monkeypatch.setattr(byte_bpe, "KEPT", kept)
        code = byte_bpe.Coder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
        assert list(code.texts(texts)) == [(",".join(map(str, ids)).encode(), len(ids), (t or "").encode()) for t, ids in zip(texts, want, strict=True)]
        assert all(isinstance(x, bytes) for x in [*code.kept.values(), *code.old.values()])


def test_anchors_and_line_order_equal_the_plain_way():
    r = np.random.default_rng(1)
    for _ in range(300):
        m = int(r.integers(20, 120))
        h, doc = r.integers(0, r.integers(2, 40), m).astype(np.uint64), np.sort(r.integers(0, r.integers(1, 5), m))
        want = {min(range(i, i + 20), key=lambda k: h[k]) for i in range(m - 19) if doc[i] == doc[i + 19]}
        assert paragraphs._anchors(h, doc).tolist() == sorted(want)
        order = paragraphs._by_line(h, doc, 5)
        assert list(zip(doc[order], h[order])) == sorted(zip(doc, h))


def test_rounds_of_centres_change_no_cluster(spark, monkeypatch):
    rnd = random.Random(5)
    base = [f"w{k}" for k in range(24)]
    # lines that drift away from one passage, one word after another
    lines = [" ".join(f"v{rnd.randrange(9)}" if k < j else w for k, w in enumerate(base)) for j in range(12) for _ in range(9)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(lines)], "doc_id long, text string")
    rounds, star = [], jaccard._star
    monkeypatch.setattr(jaccard, "_star", lambda index: rounds.append(1) or star(index))
    found = []
    for most in (10**9, 0):
        monkeypatch.setattr(paragraphs, "PAIRS_A_LINE", most)
        rounds.clear()
        found.append((sorted(paragraphs.line_clusters(docs).collect()), len(rounds)))
    assert found[0][0] == found[1][0] and found[0][1] == 3


def test_pairs_left_are_those_of_different_components(spark):
    rows = [(t, p, c) for t, n in ((1, 5), (2, 3)) for p in range(n) for c in [p // 2]]
    index = spark.createDataFrame(rows, "token long, print long, component long")
    want = sum(1 for t, p, c in rows for u, q, d in rows if t == u and p < q and c != d)
    assert paragraphs._pairs_left(index) == want and paragraphs._pairs_left(index.limit(0)) == 0
