"""Model source and sink: ALS models saved to / loaded from any Hadoop path, each
save as a version of its own (:mod:`.versions`)."""

from __future__ import annotations

from pyspark.ml.recommendation import ALSModel
from pyspark.sql import SparkSession

from .versions import current, publish, versions


def save_model(model: ALSModel, path: str, overwrite: bool = True) -> str:
    """Save as the current version of ``path``; the former stays readable until
    the new one is whole. Returns ``path``."""
    spark = model.userFactors.sparkSession
    if not overwrite and versions(spark, path):
        raise FileExistsError(f"{path} holds a model")
    publish(spark, path, lambda folder: model.write().save(folder))
    return path


def load_model(path: str) -> ALSModel:
    return ALSModel.load(current(SparkSession.active(), path))
