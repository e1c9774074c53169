"""Train / validation / test splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.selection import kth_smallest
from ..functions.splits import (SPLIT_SEED, TRAIN_BUCKETS, VALIDATION_BUCKETS, hash_bucket, row_key, split_label,
                                ts_bucket)


def with_split(ratings: DataFrame, method: str = "bucket", seed: int = SPLIT_SEED) -> DataFrame:
    """Add ``split`` in {train, validation, test} with weights 6:2:2.

    - ``bucket``: last digit of the timestamp (0-5 / 6-7 / 8-9),
    - ``hash``: md5 of (user, item, ts, seed), mod 10,
    - ``exact``: by rank of the md5 of the whole row, so that the sizes are
      6:2:2 to the row (:func:`exact_split`),
    - ``random``: a draw a row (depends on partitioning and row order; kept for
      parity with the original, not recommended).
    ``bucket`` and ``hash`` are narrow: no shuffle, any partitioning.
    """
    if method == "exact":
        return exact_split(ratings, seed)
    if method == "bucket":
        b = ts_bucket("ts")
    elif method == "hash":
        b = hash_bucket(seed)
    elif method == "random":
        b = (F.rand(seed) * 10).cast("int")
    else:
        raise ValueError(f"unknown split method {method!r}")
    return ratings.withColumn("split", split_label(b))


def exact_split(ratings: DataFrame, seed: int = SPLIT_SEED) -> DataFrame:
    """``split`` by rank: of n rows in order of :func:`..functions.splits.row_key`,
    the first ``6 n // 10`` train, up to ``8 n // 10`` validate, the rest test.

    The two cut keys are selected by counting (a few narrow passes, no sort); every
    row is then labelled by comparing its key. Rows equal in every column are
    interchangeable: where a cut falls among them, as many as needed are made
    on each side, spread over tasks. The result is the same bag of rows on
    any partitioning. ``ratings`` is read some five times: give it a table.
    """
    key = row_key(seed, ratings.columns)
    keys = ratings.select(key.alias("key"))
    n = keys.count()
    ends = [n * TRAIN_BUCKETS // 10, n * (TRAIN_BUCKETS + VALIDATION_BUCKETS) // 10]
    ranks = [r for r in ends if r]
    cuts = dict(zip(ranks, kth_smallest(keys, ranks), strict=True))
    last = [cuts[r][0] if r else "" for r in ends]                       # the last key of train, of validation
    label = lambda k: F.when(k <= last[0], F.lit("train")).when(k <= last[1], F.lit("validation")) \
        .otherwise(F.lit("test"))
    torn = {k: (below, m) for r, (k, below, m) in cuts.items() if below + m > r}
    whole = ratings.where(~key.isin(list(torn))) if torn else ratings
    out = whole.withColumn("split", label(key))
    for k, (below, m) in torn.items():
        row = ratings.where(key == k).first()
        rank = F.col("id") + below
        copies = ratings.sparkSession.range(m).select(
            *[F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in ratings.schema],
            F.when(rank < ends[0], F.lit("train")).when(rank < ends[1], F.lit("validation")).otherwise(F.lit("test"))
            .alias("split"))
        out = out.unionByName(copies)
    return out


def split(ratings: DataFrame, method: str = "bucket", seed: int = SPLIT_SEED):
    """(train, validation, test) DataFrames; columns as the input."""
    s = with_split(ratings, method, seed)
    cols = ratings.columns
    return tuple(s.where(F.col("split") == name).select(*cols)
                 for name in ("train", "validation", "test"))


def split_sizes(ratings: DataFrame, methods=("bucket", "hash"), seed: int = SPLIT_SEED):
    """``(method, split, n)`` for each method, in one pass over the ratings."""
    labelled = ratings.select(
        F.explode(F.array(*[F.struct(F.lit(m).alias("method"),
                                     split_label(ts_bucket("ts") if m == "bucket"
                                                 else hash_bucket(seed)).alias("split"))
                            for m in methods])).alias("s"))
    return labelled.groupBy("s.method", "s.split").agg(F.count(F.lit(1)).alias("n"))
