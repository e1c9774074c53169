"""Pruned top-N: the rows of the unpruned one, and what it skips."""

import numpy as np
import pytest

from ratecraft.operators.pruned import pruning_report, top_n_pruned
from ratecraft.operators.topn import top_n_by_dot


def _factors(spark, name, ids, m):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, m, strict=True)],
                                 f"{name}_id int, features array<float>").repartition(3)


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("kind", "bands"), [("ties", 1), ("ties", 7), ("long tail", 2), ("long tail", 7),
                                             ("equal norms", 7), ("zeros", 7)])
def test_rows_are_those_of_the_unpruned_search(spark, kind, bands):
    rng = np.random.default_rng(len(kind) + bands)
    users, items = rng.normal(size=(60, 5)), rng.normal(size=(400, 5))
    if kind == "ties":
        users, items = rng.integers(-2, 3, (60, 5)), rng.integers(-2, 3, (400, 5))
    elif kind == "long tail":
        items = items * (rng.pareto(1.2, (400, 1)) + 0.01)
    elif kind == "equal norms":
        items = items / np.linalg.norm(items, axis=1, keepdims=True)
    elif kind == "zeros":
        items[50:] = 0
        users[:5] = 0
    uf = _factors(spark, "user", range(60), users.astype(np.float32))
    itf = _factors(spark, "item", range(1000, 1400), items.astype(np.float32))
    rated = spark.createDataFrame([(u, i) for u in range(60) for i in range(1000, 1400) if (u * 7 + i) % 4 == 0]
                                  + [(3, i) for i in range(1000, 1398)], "user_id int, item_id int")
    for exclude in (None, rated):
        assert _rows(top_n_pruned(uf, itf, 6, exclude, bands)) == _rows(top_n_by_dot(uf, itf, 6, exclude))


def test_pairs_are_skipped(spark):
    rng = np.random.default_rng(1)
    items = rng.normal(size=(2000, 8)) * rng.pareto(1.5, (2000, 1))
    uf = _factors(spark, "user", range(300), rng.normal(size=(300, 8)).astype(np.float32))
    itf = _factors(spark, "item", range(2000), items.astype(np.float32))
    report = pruning_report(uf, itf, 10).orderBy("band").collect()
    assert sum(r.n_items for r in report) == 2000 and report[0].n_users == 300
    assert all(a.n_users >= b.n_users and a.longest > b.longest for a, b in zip(report, report[1:], strict=False))
    assert sum(r.n_items * r.n_users for r in report) < 0.5 * 300 * 2000
    assert _rows(top_n_pruned(uf, itf, 10)) == _rows(top_n_by_dot(uf, itf, 10))


def test_empty_and_missing_vectors(spark):
    uf = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "user_id int, features array<float>")
    itf = spark.createDataFrame([(5, [1.0, 0.0]), (6, None)], "item_id int, features array<float>")
    assert _rows(top_n_pruned(uf, itf, 3)) == [(1, 1, 5, 1.0)]
    assert _rows(top_n_pruned(uf, itf.where("item_id = 7"), 3)) == []
    assert pruning_report(uf, itf.where("item_id = 7"), 3).collect() == []
    assert _rows(top_n_pruned(uf.where("user_id = 7"), itf, 3)) == []
    bad = spark.createDataFrame([(5, [float("nan"), 0.0])], itf.schema)
    with pytest.raises(Exception, match="not finite"):
        top_n_pruned(uf, bad, 3).collect()
