"""Fold-in against dense solves, under hot users, and in place of a refit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratecraft.operators import foldin
from ratecraft.plans import refresh, train
from ratecraft.session import scratch_path


def _tables(spark, rows, vectors):
    ratings = spark.createDataFrame(rows, "user_id int, item_id int, rating double").repartition(5)
    items = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "item_id int, features array<float>")
    return ratings, items


def _dense(rows, vectors, reg):
    out = {}
    for u in {r[0] for r in rows}:
        mine = [(vectors[i].astype(np.float64), r) for v, i, r in rows if v == u and i in vectors]
        if mine:
            m, r = np.stack([v for v, _ in mine]), np.array([r for _, r in mine])
            out[u] = len(mine), np.linalg.solve(m.T @ m + reg * len(mine) * np.eye(m.shape[1]), m.T @ r)
    return out


def _check(got, want):
    assert {r.user_id: r.n_ratings for r in got} == {u: n for u, (n, _) in want.items()}
    for r in got:
        assert np.allclose(r.features, want[r.user_id][1], rtol=1e-4, atol=1e-5)


@pytest.mark.parametrize(("rank", "product_bytes"), [(1, 1 << 20), (4, 1 << 20), (10, 900), (33, 1 << 14)])
def test_equals_dense_solves(spark, monkeypatch, rank, product_bytes):
    monkeypatch.setattr(foldin, "PRODUCT_BYTES", product_bytes)
    rng = np.random.default_rng(rank)
    vectors = {i: rng.normal(size=rank).astype(np.float32) for i in range(60)}
    rows = [(int(u), int(i), float(r)) for u, i, r in zip(
        rng.integers(-3, 40, 900), rng.integers(0, 80, 900), rng.normal(3, 1, 900), strict=True)]
    rows += [(7, int(i), 4.0) for i in rng.integers(0, 60, 3000)]    # a hot user, with repeated pairs
    rows += [(100, 75, 5.0)]                                         # knows no item of the model
    ratings, items = _tables(spark, rows, vectors)
    got = foldin.fold_in_users(ratings, items, 0.05).collect()
    _check(got, _dense(rows, vectors, 0.05))


def test_a_hot_user_sends_one_row_a_batch(spark):
    rng = np.random.default_rng(2)
    vectors = {i: rng.normal(size=10).astype(np.float32) for i in range(50)}
    rows = [(5, int(i), 3.0) for i in rng.integers(0, 50, 20_000)] + [(u, u % 50, 1.0) for u in range(10, 300)]
    ratings, items = _tables(spark, rows, vectors)
    combine, _ = foldin._functions(10, 0.1, 1 << 20)
    sent = ratings.join(items, "item_id").select("user_id", "rating", F.col("features").cast("array<double>")) \
        .mapInArrow(combine, "user_id int, terms array<double>")
    by_user = {r.user_id: r["count"] for r in sent.groupBy("user_id").count().collect()}
    assert by_user[5] <= 16 and all(n == 1 for u, n in by_user.items() if u != 5)
    _check(foldin.fold_in_users(ratings, items, 0.1).collect(), _dense(rows, vectors, 0.1))


def test_bad_input_and_empty_tables(spark):
    vectors = {1: np.ones(3, np.float32)}
    ratings, items = _tables(spark, [(1, 1, None)], vectors)
    with pytest.raises(ValueError):
        foldin.fold_in_users(ratings, items, 0.0)
    with pytest.raises(Exception, match="a rating is null"):
        foldin.fold_in_users(ratings, items, 0.1).collect()
    ratings, items = _tables(spark, [(1, 1, float("nan"))], vectors)
    with pytest.raises(Exception, match="not finite"):
        foldin.fold_in_users(ratings, items, 0.1).collect()
    assert foldin.fold_in_users(ratings.where("user_id = 2"), items, 0.1).collect() == []
    assert foldin.fold_in_users(ratings, items.where("item_id = 2"), 0.1).collect() == []


def test_one_half_step_equals_spark(spark):
    """Spark's last half step solves the item vectors; from its final user vectors
    ours gives the same items, with the roles exchanged."""
    rng = np.random.default_rng(3)
    rows = [(int(u), int(i), float(1 + (u * i) % 5)) for u, i in zip(
        rng.integers(0, 30, 600), rng.integers(0, 25, 600), strict=True)]
    ratings = spark.createDataFrame(rows, "user_id int, item_id int, rating double")
    model = train.fit(ratings, rank=4)
    uf, itf = train.factors(model)
    turned = ratings.select(F.col("item_id").alias("user_id"), F.col("user_id").alias("item_id"), "rating")
    got = {r.user_id: r.features for r in foldin.fold_in_users(
        turned, uf.withColumnRenamed("user_id", "item_id"), train.REG_PARAM).collect()}
    users = {r.user_id: r.features for r in foldin.fold_in_users(ratings, itf, train.REG_PARAM).collect()}
    near_items = [np.allclose(got[r.item_id], r.features, rtol=1e-3, atol=1e-3) for r in itf.collect()]
    near_users = [np.allclose(users[r.user_id], r.features, rtol=1e-3, atol=1e-3) for r in uf.collect()]
    assert all(near_items) or all(near_users)


def test_refresh_users_keeps_the_rest(spark):
    rows = [(u, i, float((u * 3 + i) % 5 + 1), 1000 + u * 17 + i) for u in range(1, 40) for i in range(1, 30) if (u + i) % 3]
    history = spark.createDataFrame(rows, "user_id int, item_id int, rating double, ts long").where("user_id <> 8")
    new = spark.createDataFrame([(7, 4, 5.0, 9999), (8, 5, 1.0, 9998), (8, 6, 4.0, 9997)], history.schema)
    items = spark.createDataFrame([(i, f"Item {i}") for i in range(1, 30)], "item_id int, title string")
    old = train.fit_durable(refresh._training(history, new.limit(0), False))
    model, recs = refresh.refresh_users(old, history, new, items, n=3, path=scratch_path(spark, "folded-test"))
    before = {r.id: r.features for r in old.userFactors.collect()}
    after = {r.id: r.features for r in model.userFactors.collect()}
    assert set(after) == set(before) | {8}
    assert all(after[u] == before[u] for u in before if u != 7) and after[7] != before[7]
    assert [r for r in old.itemFactors.orderBy("id").collect()] == [r for r in model.itemFactors.orderBy("id").collect()]
    rated = {(u, i) for u, i, *_ in rows if u != 8} | {(7, 4), (8, 5), (8, 6)}
    got = recs.collect()
    assert {(r.user_id, r["rank"]) for r in got} == {(u, k) for u in (7, 8) for k in (1, 2, 3)}
    assert not {(r.user_id, r.item_id) for r in got} & rated
    assert model.transform(new.select("user_id", "item_id")).count() == 3
