"""Saves that die half-way, concurrent ones, and what readers see."""

import os

import pytest

from ratecraft.plans import prepare, train
from ratecraft.session import scratch_path
from ratecraft.sources import versions as vs
from ratecraft.sources.models import load_model, save_model
from ratecraft.sources.sinks import read_report, write_report


def _half(folder):
    """What a killed write leaves: files without a commit."""
    os.makedirs(folder.replace("file:", "") + "/_temporary/0", exist_ok=True)
    with open(folder.replace("file:", "") + "/part-00000-half.parquet", "wb") as f:
        f.write(b"PAR1 half")
    raise KeyboardInterrupt


def test_a_write_killed_half_way_leaves_the_old_table(spark):
    root = scratch_path(spark, "versions-table")
    lines = lambda *rows: spark.createDataFrame([(r,) for r in rows], "value string")
    prepare.write_ratings_table(lines("1::2::3::4"), root)
    with pytest.raises(KeyboardInterrupt):
        vs.publish(spark, root, _half)
    assert [r.user_id for r in prepare.read_ratings_table(spark, root).collect()] == [1]
    with pytest.raises(Exception, match="malformed"):
        prepare.write_ratings_table(lines("5::2::3::4", "bad"), root)
    assert [r.user_id for r in prepare.read_ratings_table(spark, root).collect()] == [1]
    before = prepare.read_ratings_table(spark, root)
    prepare.write_ratings_table(lines("7::2::3::4", "bad"), root, mode="quarantine")
    assert [r.user_id for r in prepare.read_ratings_table(spark, root).collect()] == [7]
    assert [r.user_id for r in before.collect()] == [1]  # a reader that began earlier
    assert [r.line for r in prepare.read_table_rejects(spark, root).collect()] == ["bad"]


def test_models_follow_the_marker(spark):
    ratings = spark.createDataFrame([(u, i, float((u * i) % 5)) for u in range(9) for i in range(8)],
                                    "user_id int, item_id int, rating double")
    root = scratch_path(spark, "versions-model")
    a, b = train.fit(ratings, rank=2), train.fit(ratings, rank=3)
    assert load_model(save_model(a, root)).rank == 2
    with pytest.raises(KeyboardInterrupt):
        vs.publish(spark, root, _half)
    assert load_model(root).rank == 2
    assert load_model(save_model(b, root)).rank == 3
    with pytest.raises(FileExistsError):
        save_model(a, root, overwrite=False)
    folded = train.with_users(load_model(root), spark.createDataFrame([(77, [1.0, 2.0, 3.0])], "user_id int, features array<double>"), root)
    assert folded.userFactors.count() == 10 and load_model(root).userFactors.where("id = 77").count() == 1
    plain = scratch_path(spark, "plain-model")
    a.write().save(plain)  # saved without versions
    assert load_model(plain).rank == 2


def test_reports_keep_every_column_and_version(spark):
    rows = [(1, 1, 7, "x", 2.5, 30)]
    recs = spark.createDataFrame(rows, "user_id int, rank int, item_id int, title string, score double, n_ratings long")
    root = scratch_path(spark, "versions-report")
    write_report(recs, root)
    write_report(recs.drop("rank", "n_ratings"), root)
    assert read_report(spark, root).columns == ["user_id", "item_id", "title", "score"]
    folder = write_report(recs, root, partition_cols=["user_id"])
    assert sorted(read_report(spark, root).columns) == sorted(recs.columns) and folder.endswith(vs.versions(spark, root)[-1])
    names = vs.versions(spark, root)
    assert vs.expire(spark, root, keep=1) == names[:2] and vs.expire(spark, root, keep=1) == []
    assert len(vs.versions(spark, root)) == 1 and read_report(spark, root).count() == 1
    with pytest.raises(ValueError):
        vs.expire(spark, root, keep=0)


def test_saves_that_end_together(spark):
    root = scratch_path(spark, "versions-race")
    made = []

    def outer(folder):
        spark.range(1).write.parquet(folder)
        made.append(vs.publish(spark, root, lambda f: spark.range(2).write.parquet(f)))  # another save ends first

    made.append(vs.publish(spark, root, outer))
    assert len(vs.versions(spark, root)) == 2 and vs.current(spark, root) == max(made)
