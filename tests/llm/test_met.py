"""The join of rows with one value a key, hot keys included."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from ratecraft.llm import common


def made(spark):
    # Key 0 holds a third of all rows, a null key another tenth.
    key = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 10 == 1, None).otherwise(F.col("id") % 97)
    rows = spark.range(0, 6000, 1, 64).select(key.alias("key"), F.lit("same").alias("x"))
    return rows, rows.where("key is not null and key <> 5").groupBy("key") \
        .agg(F.max(F.col("key") * 7).alias("value"), F.count("*").alias("n"))


@pytest.mark.parametrize("hot_keys", [1, 16, 1024])
def test_met_equals_a_left_join(spark, monkeypatch, hot_keys):
    monkeypatch.setattr(common, "HOT_KEYS", hot_keys)
    rows, values = made(spark)
    got = Counter(tuple(r) for r in common.met(rows, values, "key").collect())
    want = Counter(tuple(r) for r in rows.join(values, "key", "left").select("key", "x", "value").collect())
    assert got == want


def test_equal_rows_of_a_hot_key_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_KEYS", 16)
    was = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(was, ("-1", "false"), strict=True):
            spark.conf.set(k, v)
        rows, values = made(spark)
        parts = common.met(rows, values, "key").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert max(r["count"] for r in parts) < 6000 / 3
    assert sum(r["count"] for r in parts) == 6000


def test_no_rows(spark):
    rows, values = made(spark)
    assert common.met(rows.where("x = 'y'"), values.where("key = 99"), "key").collect() == []
