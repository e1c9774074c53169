"""Parse once, store once: the at-scale layout for rating data.

Text is parsed a single time and written as Parquet partitioned by the
timestamp bucket (0-9). Every later job reads typed columns with pruning and
pushdown, and a split becomes partition pruning: the training split reads
buckets 0-5 only, the held-out splits never touch those files. The write goes
to the shared folder given (the cluster's checkpoint/warehouse path), so the
table survives lost executors and is the lineage cut for everything after it.
Each write is a version of the table; readers see the last whole one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.splits import TRAIN_BUCKETS, VALIDATION_BUCKETS, ts_bucket
from ..operators.sketches import SKETCH_SCHEMA, sketches
from ..session import scratch_path
from ..sources import text
from ..sources.versions import current, publish

RATING_TABLE_SCHEMA = "user_id int, item_id int, rating double, ts bigint, bucket int"


def write_ratings_table(lines: DataFrame, path: str, mode: str = "failfast") -> str:
    """Parse ``user::item::rating::ts`` lines and write them partitioned by bucket.

    One rebalancing shuffle by bucket: AQE cuts a bucket's rows into tasks of
    ``advisoryPartitionSizeInBytes`` and merges small ones, so files have that
    size and a hot bucket is many tasks. Quarantine: the text is split once; the
    parsed lines, good and bad, are written aside and both tables read them.
    Rejects are versions of ``<path>_rejects``. Returns ``path``.
    """
    spark = lines.sparkSession
    if mode == "quarantine":
        aside = scratch_path(spark, "parsed-ratings")
        text.judge_ratings(lines).write.parquet(aside)
        judged = spark.read.parquet(aside)
        rejects = judged.where(F.col("_reason").isNotNull()) \
            .select(F.col("_line").alias("line"), F.col("_reason").alias("reason"))
        publish(spark, path.rstrip("/") + "_rejects", lambda folder: rejects.write.parquet(folder))
        parsed = judged.where(F.col("_reason").isNull()) \
            .select("user_id", "item_id", "rating", "ts").withColumn("bucket", ts_bucket("ts"))
    else:
        parsed = text.parse_ratings(lines, mode)

    def write(folder: str) -> None:
        parsed.hint("rebalance", F.col("bucket")).write.partitionBy("bucket").parquet(folder)
        kept = spark.read.schema(RATING_TABLE_SCHEMA).parquet(folder)
        sketches(kept).write.parquet(f"{folder}/_sketches")   # hidden from readers of the table

    publish(spark, path, write)
    return path


def read_ratings_table(spark: SparkSession, path: str) -> DataFrame:
    """The last whole version of the table."""
    return spark.read.schema(RATING_TABLE_SCHEMA).parquet(current(spark, path))


def read_table_sketches(spark: SparkSession, path: str) -> DataFrame:
    """Distinct-count sketches of the last whole version, a row a bucket."""
    return spark.read.schema(SKETCH_SCHEMA).parquet(f"{current(spark, path)}/_sketches")


def read_table_rejects(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("line string, reason string").parquet(current(spark, path.rstrip("/") + "_rejects"))


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split, read with partition pruning on ``bucket``."""
    t = read_ratings_table(spark, path)
    b = F.col("bucket")
    cond = {"train": b < TRAIN_BUCKETS,
            "validation": (b >= TRAIN_BUCKETS) & (b < TRAIN_BUCKETS + VALIDATION_BUCKETS),
            "test": b >= TRAIN_BUCKETS + VALIDATION_BUCKETS}[split]
    return t.where(cond)
