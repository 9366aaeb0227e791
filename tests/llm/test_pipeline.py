"""The pipeline's stages against brute force, each on its own input."""

from __future__ import annotations

import corpus_pipeline

from brute import SF, base_features, base_spans, contamination, linked_components


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    given = {r.doc_id: r for r in docs.collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.staged(stage(spark, docs, SF))
        got = {r.doc_id: r for r in out.collect()}
        assert len(got) == out.count()
        if name != "byte-level BPE":
            assert out.columns == docs.columns
        if name == "quality rules":
            f = {i: base_features(r.text) for i, r in given.items()}
            assert all(f[i][0] >= 50 and 100 * f[i][4] <= 50 * f[i][0] for i in got)
        elif name == "n-gram Jaccard join":
            assert set(got) == {c for _, c in linked_components([(i, r.text) for i, r in given.items()]).values()}
        elif name == "benchmark decontamination":
            assert set(got) == {x[0] for x in contamination([(i, r.text) for i, r in given.items()], items) if not x[5]}
        elif name == "secret scans":
            assert set(got) == set(given)
            assert all(not base_spans(r.text) for r in got.values())
            assert all(got[i].text == r.text for i, r in given.items() if not base_spans(r.text))
        else:
            assert set(got) == set(given)
        docs, given = out, got
