"""Incremental ingest of posted ratings with Structured Streaming.

Each posted request lands as a JSON record ``{"user_id": .., "body": "item,rating\\n.."}``
in a folder. The stream parses new files and adds typed rows to a ratings table
in the layout of :mod:`ratecraft.plans.prepare` (bucket folders), below a folder
of its micro-batch. A post carries no time of its own: its ``ts`` is when its
file arrived, which a replay reads again. Each batch's folder is overwritten as a
whole and the checkpoint (in the shared folder) records which files were
committed, so a restart neither drops nor duplicates a request. ``availableNow``
processes what is there and stops: the batch-refresh cadence of a request
handler without a server.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.splits import ts_bucket
from ..operators.sketches import SKETCH_SCHEMA, sketches
from ..plans.prepare import RATING_TABLE_SCHEMA
from ..sources.text import parse_posted

#: User ids are read as text: an id that isn't an int32 is a malformed line, not NULL.
POSTED_SCHEMA = "user_id string, body string, request_id string, _corrupt_record string"
POSTED_TABLE_SCHEMA = ("user_id int, item_id int, rating double, ts bigint, batch_id bigint,"
                       " bucket int")


def posted_stream(spark: SparkSession, source_dir: str, max_files_per_trigger: int = 1000):
    """New files' records, with ``ts``: the second a record's file arrived."""
    return (spark.readStream.schema(POSTED_SCHEMA)
            .option("columnNameOfCorruptRecord", "_corrupt_record")
            .option("maxFilesPerTrigger", max_files_per_trigger)
            .json(source_dir)
            .select("*", F.col("_metadata.file_modification_time").cast("timestamp").alias("arrived"))
            .withColumn("ts", F.col("arrived").cast("long")))


def once(posts: DataFrame, replay_hours: float) -> DataFrame:
    """The posts without those whose ``request_id`` came before, in any file, up
    to ``replay_hours`` of arrival time ago. The state holds one key a request
    and drops it when the watermark passes; posts without an id (and corrupt
    records) can't be told apart and all stay."""
    named = posts.where("request_id is not null").withWatermark("arrived", f"{int(replay_hours * 3600)} seconds") \
        .dropDuplicatesWithinWatermark(["request_id"])
    return named.unionByName(posts.where("request_id is null"))


def _finish(query, timeout_s: int | None, what: str) -> None:
    """Wait until all available input is processed; a time limit only on request."""
    if timeout_s is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout_s):
        query.stop()
        raise TimeoutError(f"{what} did not finish within {timeout_s}s")
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))


def rejects_path(sink_dir: str) -> str:
    return sink_dir.rstrip("/") + "_rejects"


def ingest_posted(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                  mode: str = "failfast", timeout_s: int | None = None,
                  replay_hours: float | None = None) -> DataFrame:
    """Run one ``availableNow`` ingest and return the table of posted ratings.

    With ``replay_hours`` a post that is delivered again (the same ``request_id``
    in another file or record, within that time) counts once (:func:`once`).
    Beside the table each batch leaves distinct-count sketches of its ratings
    (:mod:`..operators.sketches`). ``quarantine`` writes every malformed record or line to the table at
    :func:`rejects_path` as ``(line, reason)``; ``failfast`` fails on the first.
    """
    sink = sink_dir.rstrip("/")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        rows = parse_posted(batch, mode=mode, corrupt_col="_corrupt_record", extra=("ts",))
        if mode == "quarantine":
            rows, rejects = rows
            rejects.write.mode("overwrite").parquet(f"{rejects_path(sink)}/batch_id={batch_id}")
        (rows.withColumn("bucket", ts_bucket("ts")).sortWithinPartitions("bucket")
         .write.mode("overwrite").partitionBy("bucket").parquet(f"{sink}/batch_id={batch_id}"))
        kept = batch.sparkSession.read.schema(RATING_TABLE_SCHEMA).parquet(f"{sink}/batch_id={batch_id}")
        sketches(kept).write.mode("overwrite").parquet(f"{sink}_sketches/batch_id={batch_id}")

    posts = posted_stream(spark, source_dir)
    if replay_hours is not None:
        posts = once(posts, replay_hours)
    query = (posts.writeStream
             .option("checkpointLocation", checkpoint_dir)
             .foreachBatch(write_batch)
             .trigger(availableNow=True)
             .start())
    _finish(query, timeout_s, "ingest")
    return read_posted_table(spark, sink_dir)


def read_posted_table(spark: SparkSession, sink_dir: str) -> DataFrame:
    """Posted ratings with the columns of the ratings table."""
    return spark.read.schema(POSTED_TABLE_SCHEMA).parquet(sink_dir).select(
        "user_id", "item_id", "rating", "ts", "bucket")


def read_posted_sketches(spark: SparkSession, sink_dir: str) -> DataFrame:
    return spark.read.schema(SKETCH_SCHEMA).parquet(sink_dir.rstrip("/") + "_sketches")


def read_rejects(spark: SparkSession, sink_dir: str) -> DataFrame:
    return spark.read.schema("line string, reason string, batch_id bigint") \
        .parquet(rejects_path(sink_dir)).select("line", "reason")
