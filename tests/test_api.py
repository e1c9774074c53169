"""The facade over the original application's calls, on text files."""

import os

from pyspark.sql import functions as F

from ratecraft import api
from ratecraft.session import scratch_path


def _write(path, lines):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, "part-0.txt"), "w") as fh:
        fh.write("\n".join(lines) + "\n")


def test_end_to_end_on_text_files(spark):
    root = scratch_path(spark, "api-test").replace("file:", "")
    ratings, items = f"{root}/ratings", f"{root}/items"
    rows = [f"{u}::{i}::{(u * 3 + i) % 5 + 1}::{1000 + u * 17 + i}"
            for u in range(1, 40) for i in range(1, 30) if (u + i) % 3]
    _write(ratings, rows)
    _write(items, [f"{i}::Item {i}" for i in range(1, 30)])
    r = api.load_ratings(spark, ratings)
    it = api.load_items(spark, items)
    stats = api.dataset_stats(r).first()
    assert (stats.n_ratings, stats.n_users, stats.n_items) == (len(rows), 39, 29)
    train, val, test = api.split_ratings(r)
    model = api.train_model(train, rank=4)
    rmse = api.compute_rmse(model, test).first()
    assert rmse.n > 0 and rmse.rmse is not None
    counts = api.item_stats(r).select("item_id", "n_ratings")
    top = api.top_ratings(model, r.select("user_id").distinct(), it, counts, n=3,
                          min_ratings=5, rated=r.select("user_id", "item_id"))
    assert top.groupBy("user_id").count().agg(F.max("count")).first()[0] <= 3
    asked = api.ratings_for_items(spark, model, 1, [2, 3, 999], it, counts).collect()
    assert sorted(x.item_id for x in asked) == [2, 3]   # 999 is unknown: no prediction


def test_search_rank_and_pairwise_rmse(spark):
    from pyspark.sql import functions as F
    g = spark.range(60).select(F.col("id").cast("int").alias("user_id"),
                               F.explode(F.sequence(F.lit(0), F.lit(39))).alias("item_id"))
    g = g.withColumn("rating", ((F.col("user_id") % 7) * 0.5 + (F.col("item_id") % 5) * 0.3)
                     .cast("double"))
    k = (F.col("user_id") * 31 + F.col("item_id") * 17) % 10
    tr, va = g.where(k < 6), g.where(k >= 8)
    results, best, model = api.search_rank(tr, va, ranks=(2, 3))
    rows = {r.rank: r.rmse for r in results.collect()}
    assert set(rows) == {2, 3} and best == min(rows, key=lambda r: (rows[r], r))
    one = api.compute_rmse(model, va).first()
    # Add one copy of a held-out row: pairwise counts it 2 x 2.
    dup = va.unionByName(va.limit(1))
    pair = api.compute_rmse(model, dup, pairwise=True).first()
    assert pair.n == one.n + 3
