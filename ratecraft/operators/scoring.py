"""Scoring known (user, item) pairs with factor vectors, and enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.vectors import dot
from .skew import salted_join


def score_pairs(pairs: DataFrame, user_factors: DataFrame, item_factors: DataFrame,
                dim: int | None = None) -> DataFrame:
    """``(user_id, item_id, score)`` for listed pairs; pairs whose user or item
    has no vector get no row (inner joins, like a model's cold start "drop").

    Two equi-joins on the pair list: the factor tables are shuffled (or, when
    AQE sees one is small, broadcast) by id, the pair list is never replicated.
    """
    u = user_factors.select("user_id", F.col("features").alias("_uf"))
    i = item_factors.select("item_id", F.col("features").alias("_if"))
    return (pairs.select("user_id", "item_id")
            .join(u, "user_id").join(i, "item_id")
            .select("user_id", "item_id", dot("_uf", "_if", dim).alias("score")))


def enrich(predictions: DataFrame, items: DataFrame, counts: DataFrame,
           hot: dict | None = None) -> DataFrame:
    """Add ``title`` and ``n_ratings`` (inner joins on item, as in the original).

    Titles are deduplicated to one per item first (``max``) so a repeated item
    id cannot multiply predictions. Titles and counts, a row an item each, meet
    first; the predictions join them once, salted at hot items. ``hot`` are the
    :func:`.skew.hot_keys` of a table with the predictions' items; without it
    they are looked for in the predictions themselves.
    """
    titles = items.groupBy("item_id").agg(F.max("title").alias("title"))
    about = titles.join(counts.select("item_id", "n_ratings"), "item_id")
    return salted_join(predictions, about, "item_id", hot=hot)
