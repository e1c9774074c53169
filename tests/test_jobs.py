"""Refresh, the bucket-partitioned table, sinks and the JSON list format."""

import json
import re

from pyspark.sql import functions as F

from ratecraft.plans import prepare, refresh
from ratecraft.plans.recommend import recs_json
from ratecraft.session import scratch_path
from ratecraft.sources import fixtures as fx
from ratecraft.sources import text
from ratecraft.sources.sinks import write_report

from .conftest import SF_SMALL


def test_refresh_recommends_for_each_new_user_only_unrated(spark):
    ratings = fx.base(spark, SF_SMALL)
    latest = ratings.agg(F.max("ts")).first()[0]
    history = ratings.where(F.col("ts") < latest - 60 * 86400)
    new = ratings.where(F.col("ts") >= latest - 60 * 86400)
    items = fx.items(spark, SF_SMALL)
    _, recs = refresh.refresh(history, new, items, n=5)
    rows = recs.collect()
    new_users = {r.user_id for r in new.select("user_id").distinct().collect()}
    assert rows and {r.user_id for r in rows} <= new_users
    rated = {(r.user_id, r.item_id) for r in ratings.select("user_id", "item_id").collect()}
    assert not any((r.user_id, r.item_id) in rated for r in rows)
    per_user = recs.groupBy("user_id").count().agg(F.max("count")).first()[0]
    assert per_user <= 5


def test_ratings_table_prunes_partitions(spark):
    path = prepare.write_ratings_table(fx.ratings_lines(spark, SF_SMALL),
                                       scratch_path(spark, "ratings-test"))
    train = prepare.read_split(spark, path, "train")
    plan = train._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)
    assert train.where(F.col("bucket") >= 6).count() == 0
    total = prepare.read_ratings_table(spark, path).count()
    assert total == fx.base(spark, SF_SMALL).count()


def test_quarantine_prepare_writes_rejects(spark):
    lines = spark.createDataFrame([("1::2::3::4",), ("bad",)], "value string")
    path = prepare.write_ratings_table(lines, scratch_path(spark, "rej-test"), mode="quarantine")
    assert spark.read.parquet(path + "_rejects").collect()[0]["line"] == "bad"
    assert prepare.read_ratings_table(spark, path).count() == 1


def test_report_sink_roundtrip(spark):
    recs = spark.createDataFrame([(1, 1, 7, "x", 2.5), (1, 2, 8, "y", 1.5)],
                                 "user_id int, rank int, item_id int, title string, score double")
    path = write_report(recs, scratch_path(spark, "report-test"), fmt="json")
    back = sorted(tuple(r) for r in spark.read.schema(recs.schema).json(path).collect())
    assert back == sorted(tuple(r) for r in recs.collect())


def test_recs_json_in_rank_order(spark):
    recs = spark.createDataFrame([(1, 2, 8, 1.5), (1, 1, 7, 2.5)],
                                 "user_id int, rank int, item_id int, score double")
    out = recs_json(recs).collect()[0]
    assert json.loads(out["recs"]) == [{"item_id": 7, "score": 2.5}, {"item_id": 8, "score": 1.5}]


def test_parsed_fixture_lines_roundtrip(spark):
    base = fx.base(spark, SF_SMALL)
    parsed = text.parse_ratings(fx.ratings_lines(spark, SF_SMALL)).drop("bucket")
    assert parsed.exceptAll(base).count() == 0 and base.exceptAll(parsed).count() == 0
