"""Targets against the stated rounds; what the mix takes against the targets."""

from collections import defaultdict

import numpy as np
import pytest

from ratecraft.llm import mixing


def wanted(sizes):
    keys = sorted(sizes, key=lambda k: (k is None, k or ""))
    w = {k: (3, 1, 2)[i % 3] for i, k in enumerate(keys)}
    budget, capped = 1.5 * sum(sizes.values()), set()
    while True:
        rest = budget - sum(2 * sizes[k] for k in capped)
        weight = sum(w[k] for k in keys if k not in capped)
        t = {k: 2.0 * sizes[k] if k in capped else rest * w[k] / weight for k in keys}
        over = {k for k in keys if t[k] > 2 * sizes[k] + 1e-9}
        if not over:
            return t
        capped |= over


@pytest.fixture
def mix_docs(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(900):
        source = [None, "a", "b", "é", "tiny"][0 if i < 60 else 1 if i < 500 else 2 if i < 700 else 3 if i < 890 else 4]
        rows.append((i, " ".join(["w"] * int(rng.lognormal(3.5, 1.0))), source, 1))
    rows += [(900, None, "a", 1), (901, "", "void", 1), (None, "x y", "a", 1), (5, "x y z", "b", 1), (5, "x y z", "b", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, mix_size int").repartition(4)


def test_targets_and_taken_words(mix_docs, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 200)
    src = [(r.doc_id, r.text or "", r.source) for r in mix_docs.collect()]
    sizes = defaultdict(int)
    for _, t, s in src:
        sizes[s] += len(t.split())
    want = wanted(sizes)
    by_size = {v: k for k, v in sizes.items()}
    taken = defaultdict(int)
    got = mixing.mix_report(mix_docs).collect()
    assert len(got) == len(src)
    for r in got:
        s = by_size[r.source_size]
        assert r.target == pytest.approx(want[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.02 * t + 30
    again = sorted((r.doc_id or -1, r.size, r.taken) for r in mixing.mix_report(mix_docs).collect())
    assert again == sorted((r.doc_id or -1, r.size, r.taken) for r in got)


def test_mix_repeats_rows_unchanged(mix_docs):
    copies = sum(r.copies for r in mixing.mix_report(mix_docs).collect())
    mix = mixing.mixed(mix_docs)
    assert mix.columns == mix_docs.columns and mix.count() == copies
    assert mix.exceptAll(mix_docs.union(mix_docs)).count() == 0


def test_no_rows(mix_docs):
    none = mix_docs.where("doc_id = 12345")
    assert mixing.mix_report(none).collect() == [] and mixing.mixed(none).collect() == []
