"""Physical-plan properties of the catalogue: no cross products, pruned scans,
partial aggregation, and no Python in the plans that do not need it."""

import re

import pytest

from ratecraft.plans.catalog import QUERIES

from .conftest import SF_SMALL

SKIP = {"als_rank_search", "als_select_best", "stream_ingest", "stream_item_stats",
        "report_sink"}
NAMES = sorted(set(QUERIES) - SKIP)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_no_cartesian_product(spark, name):
    plan = _plan(QUERIES[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_scans_read_only_needed_columns(spark):
    plan = _plan(QUERIES["item_stats"](spark, SF_SMALL))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    li = [s for s in schemas if "l_orderkey" in s][0]
    assert "l_extendedprice" not in li and "l_shipdate" not in li


def test_item_stats_aggregates_partially_before_shuffle(spark):
    plan = _plan(QUERIES["item_stats"](spark, SF_SMALL))
    assert "partial_count" in plan and "partial_avg" in plan


def test_sql_expressible_queries_stay_in_the_jvm(spark):
    for name in ["parse_ratings", "item_stats", "score_pairs", "rmse_pairwise", "split_hash"]:
        plan = _plan(QUERIES[name](spark, SF_SMALL))
        assert "Python" not in plan and "ArrowEval" not in plan, name


def test_per_user_top_n_limits_before_shuffle(spark):
    plan = _plan(QUERIES["unrated_top_n"](spark, SF_SMALL))
    assert "WindowGroupLimit" in plan
