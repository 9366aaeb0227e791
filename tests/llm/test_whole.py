"""The whole job where an operator once did less: one test for each finding of the second advice."""

from __future__ import annotations

import random

import corpus_pipeline
from faretrail.llm import jaccard, paragraphs

MAX_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def _text(rng: random.Random, n: int) -> list[str]:
    return [f"w{rng.randrange(10 ** 6)}" for _ in range(n)]


def test_near_copies_meet_however_arrow_cuts_the_batches(spark):
    """A batch closes at a number of bytes over all columns, so it holds fewer rows with an id than without."""
    rng = random.Random(4)
    rows = []
    for k in range(600):
        words = _text(rng, 12)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words, f"x{k}"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    before = spark.conf.get(MAX_BYTES)
    spark.conf.set(MAX_BYTES, "8000")
    try:
        got = {r.doc_id: r.component_id for r in jaccard.join(docs).collect()}
    finally:
        spark.conf.set(MAX_BYTES, before)
    assert got == {i: i - i % 2 for i, _ in rows}


def test_short_lines_are_paragraphs(spark):
    """Near copies of a line of 20 words, equal ones of 12 and of 3."""
    rng = random.Random(5)
    line, equal, tiny = _text(rng, 20), " ".join(_text(rng, 12)), " ".join(_text(rng, 3))
    own = lambda: " ".join(_text(rng, 15))
    rows = [(1, f"{own()}\n{' '.join(line)}\n{own()}"), (2, f"{' '.join([*line[:-1], 'changed'])}\n{own()}"), (3, f"{own()}\n{equal}"),
            (4, f"{equal}\n{own()}"), (5, f"{tiny}\n{own()}"), (6, f"{own()}\n{tiny}"), (7, f"{own()}\n{own()}")]
    text = dict(rows)
    got = {r.doc_id: r for r in paragraphs.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6}
    assert {i: [text[i][s.start: s.end] for s in r.removals] for i, r in got.items()} == {
        1: [], 2: [" ".join([*line[:-1], "changed"])], 3: [], 4: [equal], 5: [], 6: [tiny]}
    assert [got[i].keep_doc_ids for i in (2, 4, 6)] == [[1], [3], [5]]


def test_one_row_of_a_group_stays(spark):
    """Repeated rows of the smallest id, and rows with a null id as copies of others, of each other and alone."""
    rng = random.Random(6)
    a, b, c, d = (" ".join(_text(rng, 30)) for _ in range(4))
    rows = [(1, a), (1, a), (2, f"{a} more"), (None, a), (None, b), (None, b), (3, c), (None, d), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, a), (None, b), (3, c), (None, d), (4, "")], key=str)


def test_repeats_within_one_document(spark):
    """A caller who asks for them gets them, told from those that span documents."""
    rng = random.Random(7)
    line, other, shared = (" ".join(_text(rng, 45)) for _ in range(3))
    rows = [(1, f"{line}\n{shared}\n{other}\n{line}"), (2, shared), (3, " ".join(_text(rng, 45)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.spans_documents): [rows[r.doc_id - 1][1][s.start: s.end] for s in r.removals] for r in paragraphs.repeats(docs, within=True).collect()}
    assert got == {(1, True): [], (2, True): [shared], (1, False): [line]}
    assert {r.doc_id for r in paragraphs.repeats(docs).collect()} == {1, 2}
