"""Deterministic train/validation/test assignment.

``randomSplit`` depends on how the input is partitioned, so the same data on
a different cluster gives a different split. These are pure functions of the
row, so every executor, and a SQL engine, assigns the same split.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The reference's split weights 6:2:2 over ten buckets and seed 24.
SPLIT_NAMES = ("train", "validation", "test")
TRAIN_BUCKETS = 6
VALIDATION_BUCKETS = 2
SPLIT_SEED = 24


def ts_bucket(ts: Column | str) -> Column:
    """Last digit of the epoch timestamp, never negative (Python ``%``)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.pmod(c, F.lit(10)).cast("int")


def hash_bucket(seed: int = SPLIT_SEED, *cols: str) -> Column:
    """Bucket 0-9 from the first 8 hex digits of md5(user|item|ts|seed)."""
    cols = cols or ("user_id", "item_id", "ts")
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in cols], F.lit(str(seed)))
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint"),
                  F.lit(10)).cast("int")


def row_key(seed: int, cols) -> Column:
    """md5 of all the columns as text and the seed; equal only for equal rows
    (a null is written as ``\\N``)."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in cols], F.lit(str(seed))))


def split_label(bucket: Column | str) -> Column:
    b = F.col(bucket) if isinstance(bucket, str) else bucket
    return (F.when(b < TRAIN_BUCKETS, F.lit("train"))
            .when(b < TRAIN_BUCKETS + VALIDATION_BUCKETS, F.lit("validation"))
            .otherwise(F.lit("test")))
