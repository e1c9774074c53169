"""Ranked lists are judged by the scores that ranked them, not by rounded ones."""

import pytest
from pyspark.sql import functions as F

from ratecraft.plans import catalog

# Equal to six decimals; the larger id is truly ahead.
CLOSE = [(1, 1, 9, 12.4215144), (1, 2, 5, 12.4215137), (1, 3, 7, 3.0)]


@pytest.fixture
def judged(spark, monkeypatch):
    def run(name, rows):
        recs = spark.createDataFrame(rows, "user_id int, rank int, item_id int, score double") \
            .withColumn("title", F.lit("a title"))
        pairs = spark.createDataFrame([(2, 9)], "user_id int, item_id int")
        counts = spark.createDataFrame([(9, 30)], "item_id int, n_ratings long")
        heldout = spark.createDataFrame([(1, "test")], "user_id int, split string")
        for owner, call, result in [
                (catalog, "_als_inputs", (None, heldout)), (catalog, "_rated_pairs", pairs),
                (catalog, "_base_counts", counts), (catalog, "_refresh_inputs", (None, None)),
                (catalog, "_items", None), (catalog.fx, "base", pairs), (catalog.train, "fit", None),
                (catalog.train, "fit_durable", None), (catalog.train, "factors", (None, None)),
                (catalog.rec, "recommend", recs), (catalog.train, "recommend_users", recs),
                (catalog.train, "recommend_all", recs), (catalog.rf, "refresh", (None, recs))]:
            monkeypatch.setattr(owner, call, lambda *a, _result=result, **k: _result)
        return [tuple(r) for r in catalog.QUERIES[name](spark, "").collect()]

    return run


NAMES = ["als_recommend", "als_recommend_subset", "als_recommend_all", "als_refresh"]


@pytest.mark.parametrize("name", NAMES)
def test_close_scores_in_order_break_nothing(judged, name):
    assert judged(name, CLOSE) == [(1, 3, 0)]


@pytest.mark.parametrize("name", NAMES)
def test_close_scores_out_of_order_are_found(judged, name):
    swapped = [(1, 1, 5, 12.4215137), (1, 2, 9, 12.4215144), (1, 3, 7, 3.0)]
    assert judged(name, swapped) == [(1, 3, 1)]
