"""How often the large tables are shuffled and parsed by the rating queries."""

import datetime as dt

import pytest

from ratecraft.plans import catalog
from ratecraft.sources import fixtures as fx


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("shuffles"))
    day = dt.datetime(2020, 1, 1)
    spark.createDataFrame([(i, i % 3 if i != 7 else None, day + dt.timedelta(i)) for i in [*range(8), 5]],
                          "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz") \
        .write.parquet(f"{root}/orders.parquet")
    spark.createDataFrame([(i % 9 if i else None, i % 4, i % 3 + 1, float(i)) for i in range(50)],
                          "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double") \
        .write.parquet(f"{root}/lineitem.parquet")
    return root


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_line_items_are_shuffled_once(spark, tables):
    for df in (fx.ratings_all(spark, tables), fx.spoiled_posts(spark, tables), fx.posted_bodies(spark, tables)):
        plan = _plan(df)
        assert plan.count("Exchange hashpartitioning(l_orderkey") == 1
        assert plan.count("Exchange") == 2 and "RoundRobin" not in plan


def test_the_personal_users_lines_are_not_shuffled(spark, tables, monkeypatch):
    few = fx.personal_rows(spark, tables)
    assert "Exchange hashpartitioning" not in _plan(few) and "RoundRobin" not in _plan(few)
    monkeypatch.setattr(fx, "MOST_BROADCAST", 1)
    many = fx.personal_rows(spark, tables)
    assert "Exchange hashpartitioning(l_orderkey" in _plan(many)
    whole = [r for r in _rows(fx.ratings_all(spark, tables).where("user_id is not null")) if r[0] == fx.PERSONAL_USER]
    assert whole and _rows(few) == _rows(many) == whole


def test_model_queries_parse_the_base_ratings_once(spark, tables):
    training, heldout = catalog._als_inputs(spark, tables)
    assert "l_orderkey" not in _plan(heldout)
    assert _plan(training).count("FileScan parquet [l_orderkey") == 1   # the personal user's own
    s = catalog.splits.with_split(catalog._base_parsed(spark, tables), "bucket")
    assert _rows(heldout) == _rows(s.where("split <> 'train'"))
    assert training.count() == s.where("split = 'train'").count() + catalog._personal_positive(spark, tables).count()


def _stored_columns(monkeypatch):
    """Name -> columns of what is written once for several jobs."""
    seen, stored = {}, catalog._stored
    monkeypatch.setattr(catalog, "_stored", lambda df, name: (seen.update({name: df.columns}), stored(df, name))[1])
    return seen


def test_model_queries_store_only_what_they_read(spark, tables, monkeypatch):
    seen = _stored_columns(monkeypatch)
    catalog.q_als_rmse_pairwise(spark, tables)
    assert seen["als-ratings"] == ["user_id", "item_id", "rating", "split"]
    whole, narrow = (catalog._als_inputs(spark, tables, c) for c in ((), catalog.MODEL_COLS))
    for a, b in zip(whole, narrow, strict=True):
        assert _rows(a.select(b.columns)) == _rows(b)


def test_requests_count_the_stored_ratings(spark, tables, monkeypatch):
    spark.createDataFrame([(i, f"part {i}") for i in range(4)], "p_partkey long, p_name string") \
        .write.mode("overwrite").parquet(f"{tables}/part.parquet")
    pairs = spark.createDataFrame([(u, i) for u in (1, 2) for i in range(4)], "user_id int, item_id int")
    monkeypatch.setattr(catalog, "_requested", lambda spark, sf: pairs)
    seen = _stored_columns(monkeypatch)
    df = catalog.full_als_score_requested(spark, tables)
    assert seen["als-ratings"] == ["user_id", "item_id", "rating", "split"]
    assert "l_orderkey" not in _plan(df)                      # no third join of lines and orders
    counts = {r["item_id"]: r["n_ratings"] for r in catalog._base_counts(spark, tables).collect()}
    got = df.select("item_id", "n_ratings").distinct().collect()
    assert got and all(counts[r["item_id"]] == r["n_ratings"] for r in got)
