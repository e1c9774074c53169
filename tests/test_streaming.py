"""Posted-ratings ingest: exactly once across restarts."""

import json
import os

import pytest

from ratecraft.session import scratch_path
from ratecraft.streaming import ingest_posted
from ratecraft.streaming.ingest import read_rejects


def _post(folder, name, records):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as fh:
        for r in records:
            fh.write(json.dumps(r) + "\n")


def test_ingest_is_incremental_and_exactly_once(spark):
    root = scratch_path(spark, "stream-test")
    assert root.startswith("file:") or root.startswith("/")
    local = root.replace("file:", "")
    src, sink, ckpt = f"{local}/in", f"{local}/out", f"{local}/ckpt"
    _post(src, "a.json", [{"user_id": 1, "body": "10,4\n11,3"}])
    out = ingest_posted(spark, src, sink, ckpt)
    assert sorted(tuple(r)[:3] for r in out.collect()) == [(1, 10, 4.0), (1, 11, 3.0)]
    # A second run with one new file adds only that file's rows.
    _post(src, "b.json", [{"user_id": 2, "body": "12,5"}])
    out = ingest_posted(spark, src, sink, ckpt)
    assert sorted(tuple(r)[:3] for r in out.collect()) == [(1, 10, 4.0), (1, 11, 3.0), (2, 12, 5.0)]
    # Nothing new: nothing appended.
    assert ingest_posted(spark, src, sink, ckpt).count() == 3


def test_running_item_stats_across_restarts(spark):
    from ratecraft.streaming import running_item_stats
    root = scratch_path(spark, "stats-test").replace("file:", "")
    src, sink, ckpt = f"{root}/in", f"{root}/out", f"{root}/ckpt"
    _post(src, "a.json", [{"user_id": 1, "body": "10,4\n11,2"}, {"user_id": 2, "body": "10,2"}])
    out = {r.item_id: (r.n_ratings, r.avg_rating) for r in
           running_item_stats(spark, src, sink, ckpt).collect()}
    assert out == {10: (2, 3.0), 11: (1, 2.0)}
    _post(src, "b.json", [{"user_id": 3, "body": "10,5\n12,1"}])
    out = {r.item_id: (r.n_ratings, r.avg_rating) for r in
           running_item_stats(spark, src, sink, ckpt).collect()}
    assert out == {10: (3, 11 / 3), 11: (1, 2.0), 12: (1, 1.0)}


def test_no_post_is_lost(spark):
    """Corrupt JSON, a missing body, a user outside int32 and bad lines are
    quarantined with a reason; failfast fails on them."""
    root = scratch_path(spark, "lost-test").replace("file:", "")
    src, sink, ckpt = f"{root}/in", f"{root}/out", f"{root}/ckpt"
    _post(src, "a.json", [{"user_id": 1, "body": "10,4\n11,x"}, {"user_id": 99999999999, "body": "12,5"},
                          {"user_id": 3}, {"user_id": "x7", "body": "1,1"}])
    with open(f"{src}/b.json", "w") as fh:
        fh.write("{not json\n")
    with pytest.raises(Exception, match="malformed posted line"):
        ingest_posted(spark, src, f"{root}/out2", f"{root}/ckpt2")
    out = ingest_posted(spark, src, sink, ckpt, mode="quarantine")
    assert [tuple(r)[:3] for r in out.collect()] == [(1, 10, 4.0)]
    rejects = sorted((r.reason, r.line) for r in read_rejects(spark, sink).collect())
    assert rejects == [("corrupt record", "{not json"), ("no body", None), ("rating", "11,x"),
                       ("user_id", "1,1"), ("user_id", "12,5")]


def test_posts_reach_refresh(spark):
    from ratecraft.__main__ import main
    from .test_cli import _write
    root = scratch_path(spark, "chain-test").replace("file:", "")
    rows = [f"{u}::{i}::{(u * 3 + i) % 5 + 1}::{1000 + u * 17 + i}"
            for u in range(1, 30) for i in range(1, 25) if (u + i) % 3]
    _write(f"{root}/ratings", rows)
    _write(f"{root}/items", [f"{i}::Item {i}" for i in range(1, 25)])
    _post(f"{root}/in", "a.json", [{"user_id": 7, "body": "2,5\n5,1"}, {"user_id": 50, "body": "3,4"}])
    assert main(["prepare", "--ratings", f"{root}/ratings", "--out", f"{root}/table"]) == 0
    assert main(["ingest", "--posted", f"{root}/in", "--out", f"{root}/posted",
                 "--checkpoint", f"{root}/ckpt"]) == 0
    assert main(["refresh", "--table", f"{root}/table", "--posted", f"{root}/posted",
                 "--items", f"{root}/items", "--model", f"{root}/model", "--out", f"{root}/recs"]) == 0
    recs = spark.read.parquet(f"{root}/recs")
    assert {r.user_id for r in recs.collect()} == {7, 50}
    assert recs.where("user_id = 50 and item_id = 3").count() == 0
    _write(f"{root}/users", ["7", "50"])
    _write(f"{root}/asked", ["7,1", "50,2", "99,1"])
    assert main(["recommend", "--model", f"{root}/model", "--items", f"{root}/items", "--table", f"{root}/table",
                 "--users", f"{root}/users", "--min-ratings", "1", "--n", "2", "--out", f"{root}/some"]) == 0
    assert {(r.user_id, r.rank) for r in spark.read.parquet(f"{root}/some").collect()} == \
        {(7, 1), (7, 2), (50, 1), (50, 2)}
    assert main(["score", "--model", f"{root}/model", "--requests", f"{root}/asked", "--items", f"{root}/items",
                 "--table", f"{root}/table", "--out", f"{root}/scores"]) == 0
    assert {(r.user_id, r.item_id) for r in spark.read.parquet(f"{root}/scores").collect()} == {(7, 1), (50, 2)}
