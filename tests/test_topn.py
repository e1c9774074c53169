"""Block top-N against brute force: many blocks, exclusions, ties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratecraft.functions.vectors import dot

from ratecraft.operators.topn import top_n, top_n_by_dot


def _brute(U, I, uids, iids, n, excl):
    out = []
    S = U.astype(np.float64) @ I.astype(np.float64).T
    for a, u in enumerate(uids):
        cand = [(-S[a, b], iids[b]) for b in range(len(iids)) if (u, iids[b]) not in excl]
        cand.sort()
        out += [(u, r + 1, i, -s) for r, (s, i) in enumerate(cand[:n])]
    return out


def test_block_topn_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    nu, ni, d, n = 37, 53, 6, 5
    U = rng.integers(-3, 4, size=(nu, d)).astype(np.float32)  # small ints: many ties
    I = rng.integers(-3, 4, size=(ni, d)).astype(np.float32)
    uids = list(range(1000, 1000 + nu))
    iids = list(range(5000, 5000 + ni))
    excl = {(uids[a], iids[b]) for a in range(nu) for b in range(ni) if (a * 7 + b) % 5 == 0}
    uf = spark.createDataFrame([(u, U[k].tolist()) for k, u in enumerate(uids)],
                               "user_id int, features array<float>")
    itf = spark.createDataFrame([(i, I[k].tolist()) for k, i in enumerate(iids)],
                                "item_id int, features array<float>")
    ex = spark.createDataFrame(sorted(excl) + sorted(excl)[:10], "user_id int, item_id int")
    got = top_n_by_dot(uf, itf, n, exclude=ex, user_blocks=3, item_blocks=4).collect()
    got = sorted((r.user_id, r.rank, r.item_id, round(r.score, 6)) for r in got)
    want = sorted((u, r, i, round(s, 6)) for u, r, i, s in _brute(U, I, uids, iids, n, excl))
    assert got == want


def test_fewer_items_than_n(spark):
    uf = spark.createDataFrame([(1, [1.0])], "user_id int, features array<float>")
    itf = spark.createDataFrame([(1, [2.0]), (2, [3.0])], "item_id int, features array<float>")
    ex = spark.createDataFrame([(1, 2)], "user_id int, item_id int")
    got = [tuple(r) for r in top_n_by_dot(uf, itf, 10, exclude=ex).collect()]
    assert got == [(1, 1, 1, 2.0)]


def test_global_top_n_ties_by_item(spark):
    df = spark.createDataFrame([(3, 1.0), (1, 1.0), (2, 5.0)], "item_id int, score double")
    assert [(r.rank, r.item_id) for r in top_n(df, 2).collect()] == [(1, 2), (2, 1)]


def test_single_user_path_matches_block_path(spark):
    from ratecraft.plans.recommend import recommend_for_user
    rng = np.random.default_rng(11)
    U = rng.integers(-3, 4, size=(5, 4)).astype(np.float32)
    I = rng.integers(-3, 4, size=(40, 4)).astype(np.float32)
    uf = spark.createDataFrame([(u, U[u].tolist()) for u in range(5)],
                               "user_id int, features array<float>")
    itf = spark.createDataFrame([(100 + i, I[i].tolist()) for i in range(40)],
                                "item_id int, features array<float>")
    rated = spark.createDataFrame([(2, 100 + i) for i in range(0, 40, 3)], "user_id int, item_id int")
    cands = spark.createDataFrame([(100 + i,) for i in range(35)], "item_id int")
    one = recommend_for_user(2, uf, itf, 7, exclude_items=rated.where("user_id = 2"),
                             candidates=cands).collect()
    blk = top_n_by_dot(uf.where("user_id = 2"), itf.join(cands, "item_id", "left_semi"), 7,
                       exclude=rated, user_blocks=1, item_blocks=3).collect()
    assert [(r.rank, r.item_id, r.score) for r in one] == \
        sorted((r.rank, r.item_id, r.score) for r in blk)
    assert recommend_for_user(99, uf, itf, 7).count() == 0


def _frames(spark, users, items):
    return (spark.createDataFrame([(k, v) for k, v in enumerate(users)], "user_id int, features array<float>"),
            spark.createDataFrame([(k, v) for k, v in enumerate(items)], "item_id int, features array<float>"))


@pytest.mark.parametrize("rank", [10, 64, 300])
def test_equal_float_vectors_tie_by_item_in_both_paths(spark, rank):
    from ratecraft.plans.recommend import recommend_for_user
    rng = np.random.default_rng(rank)
    v = [float(x) for x in rng.normal(size=rank).astype(np.float32)]
    users = [[float(x) for x in rng.normal(size=rank).astype(np.float32)] for _ in range(12)]
    uf, itf = _frames(spark, users, [v] * 300)
    got = top_n_by_dot(uf, itf, 5, user_blocks=2, item_blocks=3)
    for u in range(0, 12, 4):
        rows = sorted((r.rank, r.item_id, r.score) for r in got.where(F.col("user_id") == u).collect())
        assert [r[1] for r in rows] == [0, 1, 2, 3, 4]
        one = recommend_for_user(u, uf, itf, 5).collect()
        assert [(r.rank, r.item_id, r.score) for r in one] == rows


@pytest.mark.parametrize("bad", [float("nan"), float("inf")])
def test_scores_that_are_not_finite_fail_in_both_paths(spark, bad):
    from ratecraft.plans.recommend import recommend_for_user
    uf, itf = _frames(spark, [[1.0, 1.0]], [[1.0, 2.0], [bad, 1.0]])
    with pytest.raises(Exception, match="not finite"):
        top_n_by_dot(uf, itf, 2).collect()
    with pytest.raises(Exception, match="not finite"):
        recommend_for_user(0, uf, itf, 2).collect()


@pytest.mark.parametrize("rank", [64, 300])
def test_vectors_of_another_length_fail_at_any_rank(spark, rank):
    df = spark.createDataFrame([([1.0] * rank, [1.0] * (rank + 1))], "a array<float>, b array<float>")
    with pytest.raises(Exception, match="length mismatch"):
        df.select(dot("a", "b", rank)).collect()
    uf, itf = _frames(spark, [[1.0] * rank], [[1.0] * (rank + 1)])
    with pytest.raises(Exception, match="mismatch"):
        top_n_by_dot(uf, itf, 2).collect()


def test_dense_exclusions(spark):
    """Every user has rated all items but two; repeated pairs change nothing."""
    rng = np.random.default_rng(2)
    n_items = 400
    uf, itf = _frames(spark, rng.normal(size=(30, 3)).astype(np.float32).tolist(),
                      rng.normal(size=(n_items, 3)).astype(np.float32).tolist())
    rated = spark.range(30).select(F.col("id").cast("int").alias("user_id")).withColumn(
        "item_id", F.explode(F.sequence(F.lit(0), F.lit(n_items - 1)))).where("(item_id + user_id) % 200 <> 0")
    got = top_n_by_dot(uf, itf, 5, exclude=rated.union(rated), item_blocks=3, user_blocks=2).collect()
    want = {(u, i) for u in range(30) for i in range(n_items) if (i + u) % 200 == 0}
    assert {(r.user_id, r.item_id) for r in got} == want and len(got) == len(want)
