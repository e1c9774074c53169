"""Refresh: take newly arrived ratings in and recommend for every user who sent
some (each for their own id). :func:`refresh` retrains the whole model;
:func:`refresh_users` keeps the item vectors and solves only those users' own."""

from __future__ import annotations

from pyspark.ml.recommendation import ALSModel
from pyspark.sql import DataFrame

from ..operators.foldin import fold_in_users
from ..operators.sets import training_union
from ..operators.splits import split
from ..session import scratch_path
from . import train
from .recommend import recommend, with_titles


def refresh(history: DataFrame, new: DataFrame, items: DataFrame, n: int = 10,
            presplit: bool = False, rank: int = train.RANK, blocks: int = train.BLOCKS):
    """Returns ``(model, recs)`` where recs is ``(user_id, rank, item_id, title, score)``.

    ``presplit=False``: new ratings join the training split only (validation
    and test stay untouched); ``True``: union first, then split.
    Recommendations leave out every item the user has rated (history and new).
    """
    training = _training(history, new, presplit)
    model = train.fit_durable(training, rank=rank, blocks=blocks)
    uf, itf = train.factors(model)
    return model, _for_new(uf, itf, history, new, items, n)


def refresh_users(model: ALSModel, history: DataFrame, new: DataFrame, items: DataFrame, n: int = 10,
                  presplit: bool = False, reg_param: float = train.REG_PARAM, path: str | None = None):
    """The same for a fitted ``model``, without a refit: ``(model, recs)``.

    Each user of ``new`` gets the vector that solves their normal equations over
    the model's item vectors (:mod:`..operators.foldin`), from their ratings in
    the training split and the new ones; this is the ALS half step for those
    users. All other vectors stay. The model, saved to ``path`` (the shared
    folder by default), also scores users it has never seen; items it doesn't
    know wait for the next full refit.
    """
    users = new.select("user_id").distinct()
    mine = _training(history.join(users, "user_id", "left_semi"), new, presplit)
    folded = fold_in_users(mine, train.factors(model)[1], reg_param, model.rank)
    model = train.with_users(model, folded, path or scratch_path(new.sparkSession, "als-folded"))
    uf, itf = train.factors(model)
    return model, _for_new(uf, itf, history, new, items, n)


def _training(history: DataFrame, new: DataFrame, presplit: bool) -> DataFrame:
    cols = ["user_id", "item_id", "rating", "ts"]
    if presplit:
        return split(history.select(*cols).unionByName(new.select(*cols)))[0].select("user_id", "item_id", "rating")
    return training_union(split(history.select(*cols))[0], new)


def _for_new(uf: DataFrame, itf: DataFrame, history: DataFrame, new: DataFrame, items: DataFrame, n: int) -> DataFrame:
    users = new.select("user_id").distinct()
    rated = history.select("user_id", "item_id").unionByName(new.select("user_id", "item_id"))
    rated = rated.join(users, "user_id", "left_semi")
    recs = recommend(uf, itf, n, exclude=rated, candidates=items, users=users)
    return with_titles(recs, items).select("user_id", "rank", "item_id", "title", "score")
