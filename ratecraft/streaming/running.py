"""Per-item count and mean, kept up to date as posts arrive.

Each micro-batch of posts is parsed and summed by item, and its sums are written
to a folder of their own (a repeated batch replaces it): the change log. Every
``FOLD_EVERY`` batches the log is folded into a snapshot, one row an item, that is
committed as a version whose name says up to which batch it goes; older batches
are then dropped from the log with the next fold. A read takes the last snapshot
and the few batches after it, so its cost follows the catalogue, not the number of
micro-batches. Records and lines that can't be parsed fail the job or, with
``mode="quarantine"``, go to a rejects table with their reason, and the stream
lives on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.text import parse_posted
from ..sources.versions import _store, expire, publish, versions
from .ingest import _finish, posted_stream, rejects_path

#: Micro-batches after which the change log is folded.
FOLD_EVERY = 16
_SUMS = "item_id int, n_ratings bigint, sum_rating double"


def _folded(spark: SparkSession, sink: str) -> tuple[str | None, int]:
    """(name, last batch) of the current snapshot; (None, -1) before the first."""
    names = versions(spark, f"{sink}/snapshots")
    return (names[-1], int(names[-1].split("-")[1])) if names else (None, -1)


def _sums(spark: SparkSession, sink: str) -> DataFrame:
    """Sums by item: the snapshot and the change log after it."""
    name, upto = _folded(spark, sink)
    log = spark.read.schema(_SUMS + ", batch_id bigint").parquet(f"{sink}/changes") \
        .where(F.col("batch_id") > upto).drop("batch_id")
    if name:
        log = log.unionByName(spark.read.schema(_SUMS).parquet(f"{sink}/snapshots/version={name}"))
    return log.groupBy("item_id").agg(F.sum("n_ratings").alias("n_ratings"), F.sum("sum_rating").alias("sum_rating"))


def fold(spark: SparkSession, sink_dir: str, upto: int) -> None:
    """Commit a snapshot of everything up to batch ``upto``, and drop what the
    snapshot before it had already folded (readers of that one are done by now)."""
    sink = sink_dir.rstrip("/")
    _, before = _folded(spark, sink)
    sums = _sums(spark, sink)
    publish(spark, f"{sink}/snapshots", lambda folder: sums.write.parquet(folder), label=str(upto))
    fs, path = _store(spark, sink)
    for status in fs.listStatus(path(f"{sink}/changes")):
        name = status.getPath().getName()
        if name.startswith("batch_id=") and 0 <= int(name.split("=")[1]) <= before:
            fs.delete(status.getPath(), True)
    expire(spark, f"{sink}/snapshots")


def running_item_stats(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                       timeout_s: int | None = None, mode: str = "failfast",
                       fold_every: int = FOLD_EVERY) -> DataFrame:
    """Take in the posts that have arrived and return :func:`item_stats_snapshot`."""
    sink = sink_dir.rstrip("/")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        rows = parse_posted(batch, mode=mode, corrupt_col="_corrupt_record")
        if mode == "quarantine":
            rows, rejects = rows
            rejects.write.mode("overwrite").parquet(f"{rejects_path(sink)}/batch_id={batch_id}")
        rows.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_ratings"), F.sum("rating").alias("sum_rating")) \
            .write.mode("overwrite").parquet(f"{sink}/changes/batch_id={batch_id}")
        if batch_id - _folded(batch.sparkSession, sink)[1] >= fold_every:
            fold(batch.sparkSession, sink, batch_id)

    # Readable before the first batch, and when all batches are folded.
    spark.createDataFrame([], _SUMS).write.mode("overwrite").parquet(f"{sink}/changes/batch_id=-1")
    query = (posted_stream(spark, source_dir).writeStream
             .option("checkpointLocation", checkpoint_dir)
             .foreachBatch(write_batch)
             .trigger(availableNow=True)
             .start())
    _finish(query, timeout_s, "running item stats")
    return item_stats_snapshot(spark, sink)


def item_stats_snapshot(spark: SparkSession, sink_dir: str) -> DataFrame:
    """``(item_id, n_ratings, avg_rating)`` of all posts taken in so far."""
    return _sums(spark, sink_dir.rstrip("/")).select(
        "item_id", "n_ratings", (F.col("sum_rating") / F.col("n_ratings")).alias("avg_rating"))
