"""Running statistics with folding and rejects, replayed posts, sketches."""

import os
import re

import pytest
from pyspark.sql import functions as F

from ratecraft.operators.sketches import sketched_stats, sketches
from ratecraft.plans import prepare
from ratecraft.session import scratch_path
from ratecraft.sources import versions
from ratecraft.streaming import ingest_posted, running_item_stats
from ratecraft.streaming.ingest import read_posted_sketches, read_rejects
from ratecraft.streaming.running import item_stats_snapshot

from .test_streaming import _post


def _local(spark, name):
    return scratch_path(spark, name).replace("file:", "")


def test_reading_follows_the_catalogue_not_the_batches(spark):
    root = _local(spark, "fold-test")
    src, sink, ckpt = f"{root}/in", f"{root}/out", f"{root}/ckpt"
    want: dict = {}
    for k in range(9):
        _post(src, f"{k}.json", [{"user_id": 1, "body": f"10,{k}\n{20 + k % 3},2"}])
        for item, r in ((10, k), (20 + k % 3, 2)):
            n, s = want.get(item, (0, 0))
            want[item] = n + 1, s + r
        got = running_item_stats(spark, src, sink, ckpt, fold_every=3)
        assert {r.item_id: (r.n_ratings, r.avg_rating) for r in got.collect()} == {i: (n, s / n) for i, (n, s) in want.items()}
    names = versions.versions(spark, f"{sink}/snapshots")
    assert [n.split("-")[1] for n in names] == ["5", "8"]  # folded after batches 2, 5, 8; the first is gone
    left = {d for d in os.listdir(f"{sink}/changes") if d.startswith("batch_id=")}
    assert left == {"batch_id=-1"} | {f"batch_id={k}" for k in range(6, 9)}
    plan = item_stats_snapshot(spark, sink)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*batch_id[^\]]*> 8", plan)  # folded batches aren't opened


def test_a_fold_that_dies_leaves_the_statistics(spark, monkeypatch):
    from ratecraft.streaming import running
    root = _local(spark, "fold-crash")
    src, sink, ckpt = f"{root}/in", f"{root}/out", f"{root}/ckpt"
    _post(src, "a.json", [{"user_id": 1, "body": "10,4"}])
    running_item_stats(spark, src, sink, ckpt, fold_every=2)
    _post(src, "b.json", [{"user_id": 1, "body": "10,2\n11,1"}])

    def dies(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(running, "publish", dies)
        with pytest.raises(Exception, match="lost"):
            running_item_stats(spark, src, sink, ckpt, fold_every=2)
    for _ in range(2):  # the batch comes again, and is counted once
        got = running_item_stats(spark, src, sink, ckpt, fold_every=2)
        assert {r.item_id: (r.n_ratings, r.avg_rating) for r in got.collect()} == {10: (2, 3.0), 11: (1, 1.0)}


def test_a_bad_post_does_not_end_the_stream(spark):
    root = _local(spark, "stats-rejects")
    src, sink, ckpt = f"{root}/in", f"{root}/out", f"{root}/ckpt"
    _post(src, "a.json", [{"user_id": 1, "body": "10,4\n11,x"}, {"user_id": 3}])
    with open(f"{src}/b.json", "w") as fh:
        fh.write("{not json\n")
    with pytest.raises(Exception, match="malformed posted line"):
        running_item_stats(spark, src, f"{root}/out2", f"{root}/ckpt2")
    got = running_item_stats(spark, src, sink, ckpt, mode="quarantine")
    assert [tuple(r) for r in got.collect()] == [(10, 1, 4.0)]
    _post(src, "c.json", [{"user_id": 2, "body": "10,2"}])
    got = running_item_stats(spark, src, sink, ckpt, mode="quarantine")
    assert [tuple(r) for r in got.collect()] == [(10, 2, 3.0)]
    assert sorted((r.reason, r.line) for r in read_rejects(spark, sink).collect()) == [
        ("corrupt record", "{not json"), ("no body", None), ("rating", "11,x")]


def test_a_replayed_post_counts_once(spark):
    root = _local(spark, "replay-test")
    src, sink, ckpt = f"{root}/in", f"{root}/out", f"{root}/ckpt"
    post = {"user_id": 1, "body": "10,4", "request_id": "r1"}
    _post(src, "a.json", [post, {"user_id": 2, "body": "11,1"}, post])
    _post(src, "b.json", [post, {"user_id": 2, "body": "11,1"}, {"user_id": 1, "body": "10,4", "request_id": "r2"}])
    run = lambda: sorted(tuple(r)[:3] for r in ingest_posted(spark, src, sink, ckpt, replay_hours=1).collect())
    first = [(1, 10, 4.0), (1, 10, 4.0), (2, 11, 1.0), (2, 11, 1.0)]
    assert run() == first
    _post(src, "c.json", [post, {"user_id": 3, "body": "12,5", "request_id": "r3"}])  # in a later run
    assert run() == [*first, (3, 12, 5.0)]


def test_sketches_add_up(spark):
    ratings = spark.range(60_000).select(
        (F.col("id") % 20_011).cast("int").alias("user_id"), (F.col("id") * 7 % 307).cast("int").alias("item_id"),
        F.lit(1.0).alias("rating"), F.col("id").alias("ts"), (F.col("id") % 10).cast("int").alias("bucket"))
    whole = sketched_stats(sketches(ratings)).first()
    parts = sketched_stats(sketches(ratings.where("ts < 30000")), sketches(ratings.where("ts >= 30000"))).first()
    for got in (whole, parts):
        assert got.n_ratings == 60_000 and abs(got.n_users / 20_011 - 1) < 0.04 and abs(got.n_items / 307 - 1) < 0.04
    assert whole == parts  # the same registers
    assert tuple(sketched_stats(sketches(ratings.where("ts < 0"))).first()) == (0, 0, 0)


def test_posts_update_the_statistics_without_a_rescan(spark):
    root = _local(spark, "sketch-test")
    lines = spark.createDataFrame([(f"{u}::{u % 7}::3::{1000 + u}",) for u in range(50)], "value string")
    prepare.write_ratings_table(lines, f"{root}/table")
    table = prepare.read_table_sketches(spark, f"{root}/table")
    assert tuple(sketched_stats(table).first()) == (50, 50, 7)
    _post(f"{root}/in", "a.json", [{"user_id": 7, "body": "2,5"}, {"user_id": 99, "body": "70,1\n71,2"}])
    ingest_posted(spark, f"{root}/in", f"{root}/out", f"{root}/ckpt")
    posts = read_posted_sketches(spark, f"{root}/out")
    assert tuple(sketched_stats(table, posts).first()) == (53, 51, 9)
    assert prepare.read_ratings_table(spark, f"{root}/table").count() == 50
