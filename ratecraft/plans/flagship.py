"""The end-to-end job of the original application: load ratings and titles,
fit ALS on the training split plus the personal ratings, and recommend the
personal user's best unrated titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import sets, splits
from ..sources import fixtures as fx
from ..sources import text
from . import train
from .recommend import recommend_for_user, with_titles


def recommend_for_profile(spark: SparkSession, sf_dir: str, n: int = 10,
                          user_id: int = fx.PERSONAL_USER) -> DataFrame:
    ratings = text.parse_ratings(fx.ratings_lines(spark, sf_dir))
    personal = text.require_nonempty(text.load_positive_ratings(fx.personal_lines(spark, sf_dir)),
                                     "personal ratings")
    items = text.parse_items(fx.item_lines(spark, sf_dir))
    training = sets.training_union(splits.split(ratings)[0], personal)
    model = train.fit_durable(training)
    uf, itf = train.factors(model)
    candidates = sets.candidate_items(items, sets.excluded_items(personal))
    recs = recommend_for_user(user_id, uf, itf, n, candidates=candidates)
    return with_titles(recs, items).select("user_id", "rank", "item_id", "title",
                                           F.round("score", 6).alias("score"))
