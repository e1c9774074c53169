"""Held-out accuracy, and the interaction identity against its definition."""

import zlib

import numpy as np

from ratecraft.llm import classifier as fm


def test_linear_time_identity_matches_pairwise_sums():
    rng = np.random.default_rng(1)
    model = 0.3, rng.normal(size=fm.N_FEATURES), rng.normal(size=(fm.N_FEATURES, fm.RANK))
    feat, value = rng.choice(fm.N_FEATURES, 9, replace=False), rng.normal(size=9)
    got = fm.machine(model, np.zeros(9, np.int64), feat, value, 1)[0][0]
    want = 0.3 + (model[1][feat] * value).sum()
    for a in range(9):
        for b in range(a + 1, 9):
            want += model[2][feat[a]] @ model[2][feat[b]] * value[a] * value[b]
    assert abs(got - want) < 1e-9


def _rows(n):
    rng = np.random.default_rng(2)
    good = [f"plain{i} text" for i in range(200)]
    bad = [f"SHOUT{i}!! ##" for i in range(200)]
    return [(i, " ".join(rng.choice(good if i % 3 else bad, 40))) for i in range(n)]


def test_held_out_accuracy_and_odd_rows(spark, docs):
    rows = _rows(900) + [(None, "plain1 text"), (5000, None), (5001, ""), (5002, "plain2 text " * 4000)]
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(900)] + [(5000, None), (None, 1)],
                                   "doc_id long, quality int")
    got = fm.classify(docs(rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert 100 < len(held) < 260
    assert sum(r.predicted == int(r.doc_id % 3 != 0) for r in held) >= 0.97 * len(held)
    again = {r.doc_id: r.score for r in fm.classify(docs(rows), labels).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-6 for r in got)


def test_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in fm.classify(docs([(1, "a"), (2, None)]), none).collect()} == {0.5}
    assert fm.classify(docs([(1, "a")]).where("doc_id = 9"), none).collect() == []


def test_an_id_is_trained_on_once_however_many_rows_hold_it(spark, docs, monkeypatch):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    rows = [(i, f"text number {i}") for i in range(60)]
    seen = []
    monkeypatch.setattr(fm, "fit", lambda label, sets: seen.append((label, [(f.tolist(), v.tolist()) for f, v in sets])))
    for copies in ([], [(7, f"other {k % 3}") for k in range(500)], [(7, f"other {k % 3}") for k in range(40)]):
        fm.train(docs(rows + copies), labels)
    known = labels.where("crc32(cast(cast(doc_id as string) as binary)) % 5 != 0").count()
    assert labels.where("doc_id = 7 and crc32(cast('7' as binary)) % 5 != 0").count() == 1
    assert [len(label) for label, _ in seen] == [known] * 3
    assert seen[1] == seen[2]


def test_folds_and_predictions_follow_their_rules(spark, docs):
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(300)], "doc_id long, quality int")
    got = fm.classify(docs([*_rows(300), (5000, None)]), labels).collect()
    assert len(got) == 301
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == int(r.score >= 0.3)
