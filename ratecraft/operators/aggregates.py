"""Per-item and data-set aggregates (partial aggregation before every shuffle)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def item_stats(ratings: DataFrame) -> DataFrame:
    """``(item_id, n_ratings, avg_rating)``: count and mean per item.

    One hash aggregate with a map-side partial step: each task ships one
    (count, sum) per item it saw, so a hot item costs no more shuffle than a
    cold one.
    """
    return ratings.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_ratings"),
                                          F.avg("rating").alias("avg_rating"))


def item_counts(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_ratings"))


def rating_stats(ratings: DataFrame, approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """One row ``(n_ratings, n_users, n_items)``.

    Exact distinct counts expand each row once per distinct column; at very
    large scale ``approx=True`` switches to HyperLogLog++ sketches (no expand,
    fixed-size partial state).
    """
    if approx:
        du = F.approx_count_distinct("user_id", rsd)
        di = F.approx_count_distinct("item_id", rsd)
    else:
        du = F.count_distinct("user_id")
        di = F.count_distinct("item_id")
    return ratings.agg(F.count(F.lit(1)).alias("n_ratings"), du.alias("n_users"),
                       di.alias("n_items"))


def eligible_items(counts: DataFrame, min_ratings: int = 25) -> DataFrame:
    """Items rated at least ``min_ratings`` times (the popularity floor)."""
    return counts.where(F.col("n_ratings") >= min_ratings).select("item_id")
