"""The pipeline, each stage against the operators' own brute-force tests' rules."""

from collections import Counter

import corpus_pipeline
from ratecraft.llm.common import load
from tests.conftest import SF_SMALL

from .test_jaccard import brute


def test_stages_take_effect(spark, shared):
    docs = load(spark, SF_SMALL, "documents")
    columns, seen = docs.columns, [{r.doc_id for r in docs.select("doc_id").collect()}]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF_SMALL)
        path = shared(f"stage{i}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        rows = docs.collect()
        if i < 4:
            assert docs.columns == columns
        seen.append({r.doc_id for r in rows})
        if i == 1:
            comps = brute([(r.doc_id, r.text) for r in rows], 5, 80, 100)
            assert all(n == 0 or d == c for d, n, c in comps)
    assert all(b <= a for a, b in zip(seen[:-1], seen[1:], strict=True))
    assert len(seen[1]) < len(seen[0]) and len(seen[2]) < len(seen[1]) and seen[5] == seen[4]
    assert max(Counter(r.doc_id for r in rows).values()) == 2
    for s in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))


def test_registered():
    import __spark_entry__ as e
    names = [n for n in e.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert e.queries()["pipeline"] is corpus_pipeline.run
