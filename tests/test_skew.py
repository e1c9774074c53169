"""Hot keys: one user, one item and one copied pair each hold a large share of
the rows. Results must stay exact (checked against brute force)."""

import math

import numpy as np
import pandas as pd
import pytest

from ratecraft.operators import aggregates, evaluate, topn


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(3000):                     # background
        rows.append((int(rng.integers(1, 200)), int(rng.integers(1, 300)),
                     float(rng.integers(0, 6)), "test"))
    for k in range(1500):                     # hot user 7, many items
        rows.append((7, int(rng.integers(1, 300)), float(rng.integers(0, 6)), "test"))
    for k in range(1500):                     # hot item 42
        rows.append((int(rng.integers(1, 200)), 42, float(rng.integers(0, 6)), "test"))
    for k in range(1500):                     # one pair copied 1500 times
        rows.append((9, 9, float(k % 6), "test"))
    pdf = pd.DataFrame(rows, columns=["user_id", "item_id", "rating", "split"])
    return pdf, spark.createDataFrame(pdf, "user_id int, item_id int, rating double, split string")


def test_item_stats_exact_under_skew(skewed):
    pdf, df = skewed
    got = {r.item_id: (r.n_ratings, r.avg_rating) for r in aggregates.item_stats(df).collect()}
    want = pdf.groupby("item_id")["rating"].agg(["count", "mean"])
    assert len(got) == len(want)
    for item, (c, m) in want.iterrows():
        assert got[item][0] == c and math.isclose(got[item][1], m, rel_tol=1e-12)


def test_pairwise_rmse_exact_under_copies(skewed):
    pdf, df = skewed
    preds = df.withColumn("prediction", (df.item_id % 5).cast("double"))
    got = evaluate.rmse_pairwise(preds).collect()[0]
    p = pdf.assign(prediction=(pdf.item_id % 5).astype(float))
    j = p.merge(pdf, on=["split", "user_id", "item_id"], suffixes=("", "_a"))
    want = math.sqrt(((j.prediction - j.rating_a) ** 2).mean())
    assert got.n == len(j) and math.isclose(got.rmse, want, rel_tol=1e-9)


def test_block_topn_exact_with_hot_user_exclusions(spark, skewed):
    pdf, df = skewed
    rng = np.random.default_rng(5)
    users = sorted(pdf.user_id.unique())
    items = sorted(pdf.item_id.unique())
    U = rng.standard_normal((len(users), 4)).astype(np.float32)
    V = rng.standard_normal((len(items), 4)).astype(np.float32)
    uf = spark.createDataFrame([(int(u), U[k].tolist()) for k, u in enumerate(users)],
                               "user_id int, features array<float>")
    itf = spark.createDataFrame([(int(i), V[k].tolist()) for k, i in enumerate(items)],
                                "item_id int, features array<float>")
    got = topn.top_n_by_dot(uf, itf, 5, exclude=df, user_blocks=4, item_blocks=3).collect()
    got = {(r.user_id, r.rank): r.item_id for r in got}
    rated = set(zip(pdf.user_id, pdf.item_id))
    S = U.astype(np.float64) @ V.astype(np.float64).T
    for a, u in enumerate(users):
        cand = sorted((-S[a, b], i) for b, i in enumerate(items) if (u, i) not in rated)[:5]
        for r, (_, i) in enumerate(cand, start=1):
            assert got[(u, r)] == i
    assert len(got) == sum(min(5, len(items) - len({i for (uu, i) in rated if uu == u}))
                           for u in users)
