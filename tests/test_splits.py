"""Deterministic splits do not depend on partitioning (randomSplit does)."""

from pyspark.sql import functions as F

from ratecraft.operators import splits
from ratecraft.sources import fixtures as fx

from .conftest import SF_SMALL


def _labels(df):
    return sorted((r.user_id, r.item_id, r.ts, r.rating, r.split) for r in df.collect())


def test_hash_and_bucket_split_independent_of_partitioning(spark):
    base = fx.base(spark, SF_SMALL)
    for method in ("bucket", "hash"):
        a = splits.with_split(base.repartition(2), method)
        b = splits.with_split(base.repartition(8, "item_id"), method)
        assert _labels(a) == _labels(b)


def test_split_weights_roughly_six_two_two(spark):
    sizes = {r.split: r.n for r in splits.split_sizes(fx.base(spark, SF_SMALL))
             .where(F.col("method") == "hash").collect()}
    total = sum(sizes.values())
    assert abs(sizes["train"] / total - 0.6) < 0.05
    assert abs(sizes["validation"] / total - 0.2) < 0.05


def test_three_splits_partition_the_input(spark):
    base = fx.base(spark, SF_SMALL)
    tr, va, te = splits.split(base, "hash")
    assert tr.count() + va.count() + te.count() == base.count()
    # The split is a function of (user, item, ts): equal keys never straddle splits.
    assert tr.join(te, ["user_id", "item_id", "ts"], "left_semi").count() == 0


def test_random_split_option_partitions_the_input(spark):
    base = fx.base(spark, SF_SMALL)
    parts = splits.split(base, "random")
    assert len(parts) == 3 and sum(p.count() for p in parts) == base.count()


def test_approx_rating_stats_close_to_exact(spark):
    from ratecraft.operators.aggregates import rating_stats
    base = fx.base(spark, SF_SMALL)
    exact = rating_stats(base).first()
    approx = rating_stats(base, approx=True).first()
    assert approx.n_ratings == exact.n_ratings
    assert abs(approx.n_users - exact.n_users) <= 0.05 * exact.n_users
    assert abs(approx.n_items - exact.n_items) <= 0.05 * exact.n_items
