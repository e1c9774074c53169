"""The original application's calls, as DataFrame functions.

Each function takes a session or DataFrames and returns DataFrames (or a
fitted model); nothing is module state. Use these when moving code from the
single-user, driver-side version to Spark jobs over tables of users.

| original operation                          | here                              |
|---------------------------------------------|-----------------------------------|
| load a ratings file (optionally positives)  | :func:`load_ratings`              |
| load an item-titles file                    | :func:`load_items`                |
| count ratings, distinct users and items     | :func:`dataset_stats`             |
| count and average ratings per item          | :func:`item_stats`                |
| 6:2:2 train/validation/test split           | :func:`split_ratings`             |
| train ALS / search the rank grid            | :func:`train_model` / :func:`search_rank` |
| held-out RMSE                               | :func:`compute_rmse`              |
| top unrated items for a user                | :func:`top_ratings` (any set of users), :func:`top_ratings_for_user` |
| predicted ratings for listed items          | :func:`ratings_for_items`         |
| add new ratings and retrain                 | :func:`add_ratings`; without a refit :func:`fold_in_ratings` |
"""

from __future__ import annotations

from pyspark.ml.recommendation import ALSModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators import aggregates, evaluate, scoring, skew, splits
from .plans import recommend as rec
from .plans import refresh, train
from .sources import text


def load_ratings(spark: SparkSession, path: str, positive_only: bool = False,
                 mode: str = "failfast"):
    """``user::item::rating::ts`` text -> typed ratings (quarantine: (good, rejects))."""
    lines = text.read_lines(spark, path)
    if not positive_only:
        return text.parse_ratings(lines, mode)
    loaded = text.load_positive_ratings(lines, mode)
    text.require_nonempty(loaded[0] if mode == "quarantine" else loaded, "ratings")
    return loaded


def load_items(spark: SparkSession, path: str, mode: str = "failfast"):
    return text.parse_items(text.read_lines(spark, path), mode)


def dataset_stats(ratings: DataFrame, approx: bool = False) -> DataFrame:
    return aggregates.rating_stats(ratings, approx)


def item_stats(ratings: DataFrame) -> DataFrame:
    return aggregates.item_stats(ratings)


def split_ratings(ratings: DataFrame, method: str = "bucket"):
    """(train, validation, test) with weights 6:2:2."""
    return splits.split(ratings, method)


def train_model(training: DataFrame, rank: int = train.RANK, **kw) -> ALSModel:
    return train.fit(training, rank=rank, **kw)


def search_rank(training: DataFrame, validation: DataFrame, ranks=train.RANK_GRID, **kw):
    """``(results(rank, rmse), best_rank, best_model)``."""
    return train.rank_search(training, validation, ranks, **kw)


def compute_rmse(model: ALSModel, heldout: DataFrame, pairwise: bool = False) -> DataFrame:
    """RMSE per split (held-out rows need a ``split`` column; one is added if absent)."""
    if "split" not in heldout.columns:
        heldout = heldout.withColumn("split", F.lit("test"))
    preds = train.predict(model, heldout)
    return evaluate.rmse_pairwise(preds) if pairwise else evaluate.rmse_by_split(preds)


def top_ratings(model: ALSModel, users: DataFrame, items: DataFrame, counts: DataFrame,
                n: int = 10, min_ratings: int | None = 25,
                rated: DataFrame | None = None) -> DataFrame:
    """Top-N unrated items per user of ``users(user_id)``:
    ``(user_id, rank, item_id, title, score, n_ratings)``.

    Items below ``min_ratings`` and pairs in ``rated`` are excluded before ranking.
    """
    uf, itf = train.factors(model)
    recs = rec.recommend(uf, itf, n, exclude=rated, candidates=items, counts=counts,
                         min_ratings=min_ratings, users=users)
    return rec.with_counts(rec.with_titles(recs, items), counts).select(
        "user_id", "rank", "item_id", "title", "score", "n_ratings")


def top_ratings_for_user(model: ALSModel, user_id: int, items: DataFrame, counts: DataFrame,
                         n: int = 10, min_ratings: int | None = 25,
                         rated: DataFrame | None = None) -> DataFrame:
    """The same for one user, without Python workers: the user's vector becomes
    literals and the ranking one ordered limit."""
    uf, itf = train.factors(model)
    mine = rated.where(F.col("user_id") == user_id) if rated is not None else None
    recs = rec.recommend_for_user(user_id, uf, itf, n, exclude_items=mine, candidates=items,
                                  counts=counts, min_ratings=min_ratings)
    return rec.with_counts(rec.with_titles(recs, items), counts).select(
        "user_id", "rank", "item_id", "title", "score", "n_ratings")


def ratings_for_items(spark: SparkSession, model: ALSModel, user_id: int, item_ids,
                      items: DataFrame, counts: DataFrame) -> DataFrame:
    """Predicted ratings for one user and a list of items (an in-memory request):
    ``(user_id, item_id, title, score, n_ratings)``."""
    requests = spark.createDataFrame([(int(user_id), int(i)) for i in item_ids],
                                     "user_id int, item_id int")
    return score_requests(model, requests, items, counts)


def score_requests(model: ALSModel, requests: DataFrame, items: DataFrame,
                   counts: DataFrame) -> DataFrame:
    """Requested (user, item) pairs scored by the model, with titles and counts."""
    preds = train.predict(model, requests.select("user_id", "item_id")) \
        .withColumnRenamed("prediction", "score")
    hot = skew.hot_keys(requests, "item_id")
    return scoring.enrich(preds, items, counts, hot).select("user_id", "item_id", "title", "score", "n_ratings")


def add_ratings(history: DataFrame, new: DataFrame, items: DataFrame, n: int = 10, **kw):
    """Fold ``new`` ratings into training, retrain and recommend for each of
    their users: ``(model, recs(user_id, rank, item_id, title, score))``."""
    return refresh.refresh(history, new, items, n, **kw)


def fold_in_ratings(model: ALSModel, history: DataFrame, new: DataFrame, items: DataFrame, n: int = 10, **kw):
    """Take ``new`` ratings in without a refit: the vectors of their users are
    solved for the model's item vectors. ``(model, recs)`` as :func:`add_ratings`."""
    return refresh.refresh_users(model, history, new, items, n, **kw)
