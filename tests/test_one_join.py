"""Queries that read the base ratings in many places join line items and orders for them once."""

import datetime as dt

import pytest

from ratecraft.plans import catalog


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("one-join"))
    day = dt.datetime(2020, 1, 1)
    spark.createDataFrame([(i, i % 6, day + dt.timedelta(i)) for i in range(60)],
                          "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz") \
        .write.parquet(f"{root}/orders.parquet")
    spark.createDataFrame([(i % 60, (i % 6 + i // 6 % 8) % 11, i % 4 + 1, float(i % 50)) for i in range(600)],
                          "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double") \
        .write.parquet(f"{root}/lineitem.parquet")
    spark.createDataFrame([(i, f"part {i}") for i in range(14)], "p_partkey long, p_name string") \
        .write.parquet(f"{root}/part.parquet")
    return root


@pytest.mark.parametrize("name", ["als_recommend", "als_refresh", "als_fold_in"])
def test_the_base_ratings_are_joined_once(spark, tables, monkeypatch, name):
    calls, base = [], catalog.fx.base
    monkeypatch.setattr(catalog.fx, "base", lambda *a: calls.append(a) or base(*a))
    got = catalog.QUERIES[name](spark, tables).collect()
    assert len(calls) == 1
    assert got and all(r["solved"] if name == "als_fold_in" else r["n_broken"] == 0 for r in got)
