"""The salted join: rows of a plain join, and no task with all of a hot key."""

import pytest
from pyspark.sql import functions as F

from ratecraft.operators import scoring, skew


@pytest.fixture
def tables(spark):
    rows = spark.range(30_000).repartition(6).select(
        F.when(F.col("id") % 3 == 0, 42).when(F.col("id") % 50 == 1, F.lit(None))
        .otherwise(F.col("id") % 997).cast("int").alias("item_id"),
        (F.col("id") % 5).cast("int").alias("salt"), F.lit(1.0).alias("score"))
    items = spark.range(900).select(F.col("id").cast("int").alias("item_id"), F.concat(F.lit("t"), "id").alias("title"))
    counts = spark.range(950).select(F.col("id").cast("int").alias("item_id"), (F.col("id") * 2).alias("n_ratings"))
    return rows, items, counts


def _rows(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("slice_rows", [100, 1000, 1 << 20])
def test_rows_are_those_of_a_plain_join(tables, how, slice_rows):
    rows, items, _ = tables
    assert _rows(skew.salted_join(rows, items, "item_id", how, slice_rows=slice_rows)) == _rows(rows.join(items, "item_id", how))


def test_hot_keys_are_found_within_the_bound(tables):
    rows, _, _ = tables
    hot = skew.hot_keys(rows, "item_id", 1000)
    assert set(hot) == {42} and 10 <= hot[42] <= 12
    assert skew.hot_keys(rows, "item_id") == {} and skew.hot_keys(rows.where("item_id < 0"), "item_id") == {}
    text = rows.select(F.col("item_id").cast("string").alias("item_id"), "salt")
    assert set(skew.hot_keys(text, "item_id", 1000)) == {"42"}


def test_a_key_with_a_third_of_the_rows_is_dealt_evenly(spark, tables):
    rows, items, counts = tables
    names = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16",
             "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        def largest(df):
            return df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]

        plain = largest(rows.join(items, "item_id"))
        dealt = largest(skew.salted_join(rows, items, "item_id", slice_rows=500))
        enriched = largest(scoring.enrich(rows, items, counts, hot=skew.hot_keys(rows, "item_id", 500)))
        none = largest(skew.salted_join(rows.where("item_id is null"), items, "item_id", "left"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    total = rows.join(items, "item_id").count()
    assert plain > total / 3 and dealt < 2.5 * total / 16 and enriched < 2.5 * total / 16
    assert none < 400 / 2  # 30 different rows and tasks in all


def test_other_joins_are_refused(tables):
    with pytest.raises(ValueError):
        skew.salted_join(*tables[:2], "item_id", "outer")
