"""Operators 11 to 13 against brute force, their SQL, and odd, empty and clashing tables."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brute import SF, documents, sha  # noqa: F401
from faretrail.llm import fill_middle, line_dedup, oracle, pivot_codes, queries


@pytest.mark.parametrize("name", list(oracle.SQL))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    want = con.sql(oracle.SQL[name])
    got = queries.QUERIES[name](spark, SF)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


# 11 vector codes ------------------------------------------------------------------
def brute_codes(rows, entries=256, rounds=4):
    """``rows`` of (id, integer vector, label) in the order of ids, with Python's integers alone."""
    size = len(rows[0][1]) // 4
    part = [[v[p * size: (p + 1) * size] for _, v, _ in rows] for p in range(4)]
    books = [x[:entries] for x in part]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assigned = lambda: [[min((far(x, e), k) for k, e in enumerate(books[p])) for x in part[p]] for p in range(4)]
    for _ in range(rounds):
        found, new = assigned(), []
        for p in range(4):
            own = defaultdict(list)
            for (_, k), x in zip(found[p], part[p]):
                own[k].append(x)
            new.append([[sum(c) // len(own[k]) for c in zip(*own[k])] if own[k] else e for k, e in enumerate(books[p])])
        books = new
    found = assigned()
    error = [sum(found[p][i][0] for p in range(4)) for i in range(len(rows))]
    of_label = Counter()
    for (_, _, label), e in zip(rows, error):
        of_label[label] += e
    digest = sha(",".join(str(v) for part in books for e in part for v in e).encode())
    return sorted((r[0], bytes(found[p][i][1] for p in range(4)).hex(), error[i], of_label[r[2]], digest) for i, r in enumerate(rows))


def integers(v):
    return [int(x) * 1024 if abs(x) >= 2.0**53 else int(np.floor(x * 1024)) for x in v]


VECTORS = "vec_id long, embedding array<double>, label int"


def test_codes_of_odd_vectors(spark):
    """Nulls, non-finite components, other lengths, repeated rows, null labels and components beyond double precision's integers."""
    rng = random.Random(2)
    good = [(k, [rng.uniform(-3, 3) for _ in range(8)], rng.choice([None, 1, 2])) for k in range(2, 60)]
    good += [(60, [3e7, -3e7, 1.5e8, 0.25, 1.0, 2.0, 1e9, -1e9], 1), (61, [1e15 + 0.5] * 8, None), good[0]]
    bad = [(0, None, 1), (1, [1.0] * 7 + [None], 1), (70, [float("nan")] * 8, 2), (71, [float("inf")] + [0.0] * 7, 2), (72, [0.5] * 4, 1), (73, [0.5] * 6, 1), (74, [], 1)]
    df = spark.createDataFrame(good + bad, VECTORS).repartition(5)
    got = pivot_codes.codes(df, rounds=2).drop("label").collect()
    # repeated ids are ordered by their vectors, so the codebook holds them next to each other
    rows = [(i, integers(v), label) for i, v, label in sorted(good, key=lambda r: (r[0], r[1]))]
    assert sorted(map(tuple, got)) == brute_codes(rows, rounds=2)
    assert pivot_codes.codes(df.where("vec_id = 70")).count() == 0
    clash = df.selectExpr("vec_id", "embedding", "label AS near", "embedding AS vec", "1 AS part", "2 AS id")
    assert pivot_codes.codes(clash, label="near").columns == ["vec_id", "near", "code", "error", "label_error", "codebooks_sha256"]
    assert pivot_codes.codes(clash, label="near").count() == len(good)


def test_errors_beyond_a_long(spark):
    rows = [(1, [0.0] * 4, 1), (2, [1e30] * 4, 1), (3, [-1e30] * 4, 1)]
    df = spark.createDataFrame(rows, VECTORS)
    found = {r.vec_id: r for r in pivot_codes.codes(df, rounds=1).collect()}
    assert [found[k].error for k in (1, 2, 3)] == [0, 0, 0]
    rows += [(k, [0.0] * 4, 1) for k in range(4, 300)] + [(300, [1e30] * 4, 2)]
    many = spark.createDataFrame([(k - 3 if k > 3 else k + 300, v, label) for k, v, label in rows], VECTORS)
    assert max(r.error for r in pivot_codes.codes(many, rounds=0).collect()) == pivot_codes.MAX_LONG


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 300), st.integers(1, 40), st.integers(1, 6), st.integers(0, 2**32))
def test_bounds_lose_no_entry(n, entries, spread, seed):
    """Ties included: small integers give many equal distances."""
    rng = np.random.default_rng(seed)
    x = rng.integers(-spread, spread + 1, (n, 3)).astype(float)
    c = rng.integers(-spread, spread + 1, (entries, 3)).astype(float)
    pivots = pivot_codes.far_apart(c, 3)
    who, best, _ = pivot_codes.nearest(x, pivot_codes.distances(x, pivots), c, (c**2).sum(1), pivot_codes.distances(c, pivots))
    d = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (who == d.argmin(1)).all() and (best == d.min(1)).all()


def test_bounds_leave_entries_out():
    rng = np.random.default_rng(3)
    c = rng.integers(-10**4, 10**4, (256, 4)).astype(float)
    x = c[rng.integers(0, 256, 4000)] + rng.integers(-20, 20, (4000, 4))
    pivots = pivot_codes.far_apart(c, pivot_codes.PIVOTS)
    evaluated = pivot_codes.nearest(x, pivot_codes.distances(x, pivots), c, (c**2).sum(1), pivot_codes.distances(c, pivots))[2]
    assert evaluated < 0.25 * x.shape[0] * len(c)


@given(st.lists(st.integers(-2**200, 2**200), min_size=1, max_size=4))
def test_limbs_add_up(values):
    total = [0] * len(values)
    for _, _, k, row in pivot_codes.limbs({(0, 0): values}):
        assert all(abs(v) < 1 << 32 for v in row)
        total = [a + (b << 32 * k) for a, b in zip(total, row)]
    assert total == values


# 12 fill in middle -----------------------------------------------------------------
def brute_cut(doc, text, seed=1, rate=90, spm=20):
    text = text or ""
    h = [int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[k: k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm:
        return n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


def test_cuts_of_odd_texts(spark):
    texts = [None, "", "a", "<P> x", "é" * 9000 + "😀 日本" * 5000, "word " * 60_000, "<", "S>", "x<", "\n \t", "ab<M>"]
    rows = [(k, t, 5, "out") for k in (None, *range(12)) for t in texts] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, cut string")
    got = fill_middle.fill_middle(df, output=True).collect()
    want = [(k, t, "out", *brute_cut(k, t)) for k, t, _, _ in rows]
    assert sorted(((r.doc_id, r.text, r.cut, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=str) == sorted(want, key=str)
    assert all(r.output_sha256 == sha(r.output.encode()) and r.restored_sha256 == sha((r.text or "").encode()) for r in got)
    assert fill_middle.fill_middle(df.limit(0)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="aé😀 \n<PSM>", max_size=60), st.sampled_from(["point", "word", "line"]), st.integers(1, 9))
def test_descent_finds_every_cut(text, unit, block):
    raw = np.frombuffer(text.encode(), np.uint8)
    cuts = fill_middle.Cuts(raw, unit, block)
    starts = [*np.flatnonzero(cuts.starts).tolist(), len(raw)]
    assert cuts.n == len(starts) - 1 and cuts.n_points == len(text)
    for k, byte in enumerate(starts):
        assert cuts.after(k) == (byte, len(raw[:byte].tobytes().decode()))


@given(st.text(alphabet="ab<PSM>", max_size=20), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1))
def test_outputs_are_restored(text, a, b):
    raw = text.encode()
    for spm in (0, 100):
        out, _, form, _, _ = fill_middle.transform(raw, np.frombuffer(raw, np.uint8), [a, b, 0, 0], "point", 90, spm)
        assert fill_middle.restore(out, form) == raw
    with pytest.raises(ValueError):
        fill_middle.restore(b"no marks", "psm")


# 13 lines -----------------------------------------------------------------------------
def brute_lines(rows, least=20, often=3):
    """Kept text and dropped lines of each (id, text); rows of one id are one document, null ids one below all others."""
    rank = lambda d: (d is not None, d or 0)
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                holders[key(x)].add(rank(d))
    for d, t in rows:
        lines = (t or "").split("\n")
        gone = [len(key(x)) >= least and len(holders[key(x)]) >= often and rank(d) != max(holders[key(x)]) for x in lines]
        yield d, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)


def kept(df, **options):
    out = line_dedup.keep_bitmaps(df, **options).withColumn("kept", line_dedup.kept_text())
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in out.collect()), key=str)


ODD_LINES = "doc_id long, text string, none int, version string"


def test_an_id_of_many_texts(spark):
    """Its rows are dealt to several ranges and passed on, not held; two documents are too few, three enough."""
    line, other = "a line that two documents hold, one of them often", "a line that three documents hold, one of them often"
    rows = [(7, f"{line}\n{other}\n{k}") for k in range(300)] + [(9, f"{line}\n{other}"), (3, other)] + [(None, f"{line[:30]} x\n{k}") for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for least in (2, 3):
        assert kept(df, partitions=5, least_docs=least) == sorted(brute_lines(rows, often=least), key=str)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 4)), max_size=40), st.integers(1, 4), st.integers(1, 5), st.data())
def test_streams_decide_as_a_whole(pairs, least, held, data):
    """Rows cut into ranges anywhere: what goes and what is passed on together decide every row."""
    rows = sorted(((h, -d, k) for k, (h, d) in enumerate(pairs)))
    cuts = sorted(data.draw(st.lists(st.integers(0, len(rows)), max_size=3)))
    gone, passed = set(), []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(line_dedup, "HELD", held)
        for a, b in zip([0, *cuts], [*cuts, len(rows)]):
            stream = line_dedup.Stream(least)
            part = rows[a:b]
            fed = {"h1": [r[0] for r in part], "h2": [0] * len(part), "none": [False] * len(part), "doc": [-r[1] for r in part], "row": [r[2] for r in part]}
            for r in [*stream.feed(fed), *stream.end()]:
                (gone.add(r["row"]) if r["settled"] else passed.append(r))
    for h in {r["h1"] for r in passed}:
        own = [r for r in passed if r["h1"] == h]
        docs = {r["doc"] for r in own}
        if max(len(docs), max(r["docs"] for r in own)) >= least:
            gone |= {r["row"] for r in own if r["doc"] != max(docs)}
    holders = defaultdict(set)
    for h, d in pairs:
        holders[h].add(d)
    assert gone == {k for k, (h, d) in enumerate(pairs) if len(holders[h]) >= least and d != max(holders[h])}


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_lines_of_odd_documents(spark, partitions):
    """A line of every document over several ranges, twos and threes, nulls, repeated ids, white space, other scripts."""
    rng = random.Random(partitions)
    pool = ["The very common line of all documents", "  the VERY common line of all documents\t", "exactly nineteen ch", "exactly twenty chars",
            "ÀÉ twenty points of é😀", "日本語日本語日本語日本語日本語日本語日", "日本語日本語日本語日本語日本語日本語日本", "", " \t", "held by two alone, or not"]
    rows = [(k, "\n".join(rng.choices(pool, k=rng.randrange(8)))) for k in range(120)]
    rows += [(None, pool[0] + "\n" + pool[9]), (None, pool[0]), (None, None), (5, pool[0]), (5, pool[0]), (200, ""), (201, "\n\n"), (202, (pool[3] + "\n") * 20_000)]
    df = spark.createDataFrame([(d, t, 1, "v") for d, t in rows], ODD_LINES).repartition(4)
    assert kept(df, partitions=partitions) == sorted(brute_lines(rows), key=str)
    assert kept(df, partitions=partitions, least_docs=2, least_points=5) == sorted(brute_lines(rows, 5, 2), key=str)
    assert line_dedup.keep_bitmaps(df.limit(0)).count() == 0
    assert line_dedup.keep_bitmaps(df).columns == ["doc_id", "text", "none", "version", "n_lines", "n_dropped", "keep_bits"]


def test_lines_join_by_shuffle_too(spark, documents, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_DOCS", 0)
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert kept(df) == sorted(brute_lines([(i, r.text) for i, r in documents.items()]), key=str)


def test_a_hot_line_spans_ranges(spark):
    """Its rows are dealt to every range rather than to one task."""
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one line that stands in every document").alias("text"))
    rows = line_dedup.staged(line_dedup.line_rows(df, "doc_id", "text", 20))
    order = ["h1", "h2", "none", F.col("doc").desc()]
    sizes = [r["count"] for r in rows.repartitionByRange(8, *order).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1000
    gone = line_dedup.dropped_lines(rows, 3, 8)
    assert gone.count() == 3999 and gone.where("doc = 3999").count() == 0
