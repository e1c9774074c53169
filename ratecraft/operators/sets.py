"""Unions, exclusions and candidate sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

RATING_COLS = ["user_id", "item_id", "rating"]


def training_union(training: DataFrame, extra: DataFrame) -> DataFrame:
    """Bag union of the training split with personal/new ratings (no dedupe)."""
    return training.select(*RATING_COLS).unionByName(extra.select(*RATING_COLS))


def excluded_items(rated: DataFrame) -> DataFrame:
    """Distinct items present in a set of ratings."""
    return rated.select("item_id").distinct()


def candidate_items(items: DataFrame, excluded: DataFrame) -> DataFrame:
    """All items minus the excluded ones. ``left_anti`` keeps duplicate item
    rows of the left side, like a bag subtract."""
    return items.select("item_id").join(excluded.select("item_id"), "item_id", "left_anti")


def pairs_for_user(items: DataFrame, user_id: int) -> DataFrame:
    """``(user_id, item_id)`` for one user and every given item (no join)."""
    return items.select(F.lit(user_id).cast("int").alias("user_id"), "item_id")


def unrated_pairs(pairs: DataFrame, rated: DataFrame) -> DataFrame:
    """Drop pairs the user has already rated (anti-join on both keys)."""
    return pairs.join(rated.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
