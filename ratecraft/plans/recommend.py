"""Recommendation jobs composed from the operators.

Order matters for exactness: the popularity floor and the already-rated
exclusion are applied *before* ranking (a top-N taken first and filtered
afterwards comes up short), and titles are attached *after* ranking, to N rows
per user only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.aggregates import eligible_items
from ..functions.vectors import dot, finite
from ..operators.pruned import top_n_pruned
from ..operators.topn import top_n, top_n_by_dot


def titles(items: DataFrame) -> DataFrame:
    """One title per item id (``max`` if an id repeats)."""
    return items.groupBy("item_id").agg(F.max("title").alias("title"))


def recommend(user_factors: DataFrame, item_factors: DataFrame, n: int,
              exclude: DataFrame | None = None, candidates: DataFrame | None = None,
              counts: DataFrame | None = None, min_ratings: int | None = None,
              users: DataFrame | None = None, prune: bool = False) -> DataFrame:
    """``(user_id, rank, item_id, score)``: top-N per user among eligible items.

    - ``users(user_id)``: restrict users (semi-join);
    - ``candidates(item_id)``: restrict items (semi-join), e.g. items minus
      those the profile rated;
    - ``counts(item_id, n_ratings)`` + ``min_ratings``: popularity floor;
    - ``exclude(user_id, item_id)``: pairs to skip (already rated);
    - ``prune``: the same rows by :mod:`..operators.pruned`, which pays when the
      item vectors' norms differ much.
    """
    items = item_factors
    if candidates is not None:
        items = items.join(candidates.select("item_id"), "item_id", "left_semi")
    if min_ratings is not None:
        items = items.join(eligible_items(counts, min_ratings), "item_id", "left_semi")
    chosen = user_factors
    if users is not None:
        chosen = chosen.join(users.select("user_id").distinct(), "user_id", "left_semi")
    if prune:
        return top_n_pruned(chosen, items, n, exclude=exclude)
    # Blocks are sized by the unfiltered tables (a cheap scan and an upper
    # bound), so the filters above run once, inside the scoring job.
    return top_n_by_dot(chosen, items, n, exclude=exclude,
                        sized_from=(user_factors, item_factors))


def recommend_for_user(user_id: int, user_factors: DataFrame, item_factors: DataFrame, n: int,
                       exclude_items: DataFrame | None = None,
                       candidates: DataFrame | None = None, counts: DataFrame | None = None,
                       min_ratings: int | None = None) -> DataFrame:
    """``(user_id, rank, item_id, score)`` for one user, all in the JVM.

    The user's vector is one row (a single-row action) and becomes literals in
    an unrolled dot product over the item rows; eligibility and exclusion are
    semi/anti-joins on item; the top N is one ordered limit
    (TakeOrderedAndProject: a bounded heap per task, N rows per task merged).
    An unknown user gets no rows.
    """
    row = (user_factors.where((F.col("user_id") == user_id) & F.col("features").isNotNull())
           .select("features").first())
    spark = item_factors.sparkSession
    if row is None:
        return spark.createDataFrame([], "user_id int, rank int, item_id int, score double")
    vec = [float(x) for x in row["features"]]
    items = item_factors
    if candidates is not None:
        items = items.join(candidates.select("item_id"), "item_id", "left_semi")
    if min_ratings is not None:
        items = items.join(eligible_items(counts, min_ratings), "item_id", "left_semi")
    if exclude_items is not None:
        items = items.join(exclude_items.select("item_id"), "item_id", "left_anti")
    lit_vec = F.array(*[F.lit(v) for v in vec])
    scored = items.where(F.col("features").isNotNull()).select(
        F.lit(user_id).cast("int").alias("user_id"), "item_id",
        finite(dot("features", lit_vec, len(vec))).alias("score"))
    return top_n(scored, n).select("user_id", "rank", "item_id", "score")


def with_titles(recs: DataFrame, items: DataFrame) -> DataFrame:
    """Attach titles to ranked rows (N per user; items keep their own partitioning)."""
    return recs.join(titles(items), "item_id")


def with_counts(recs: DataFrame, counts: DataFrame) -> DataFrame:
    return recs.join(counts.select("item_id", "n_ratings"), "item_id")


def recs_json(recs: DataFrame) -> DataFrame:
    """``(user_id, recs)``: each user's ranked list as a JSON array of
    ``{"item_id", "score"}`` objects in rank order (N entries per user)."""
    grouped = recs.groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "item_id", "score"))).alias("_l"))
    return grouped.select("user_id", F.to_json(F.transform(
        "_l", lambda x: F.struct(x["item_id"].alias("item_id"), x["score"].alias("score"))))
        .alias("recs"))
