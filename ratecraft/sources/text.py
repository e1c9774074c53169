"""Text sources: ``user::item::rating::ts`` ratings, ``item::title`` items and
posted ``item,rating`` bodies, parsed with built-in functions only.

Malformed lines: ``mode="failfast"`` (default) fails the job on the first bad
line, as a parse exception would; ``mode="quarantine"`` returns the good rows
and a rejects table ``(line, reason)`` instead.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import (DoubleType, IntegerType, LongType, StringType, StructField,
                               StructType)

from ..functions.parsing import float_field, int_field, py_strip, text_field
from ..functions.splits import ts_bucket

RATING_SCHEMA = StructType([
    StructField("user_id", IntegerType()),
    StructField("item_id", IntegerType()),
    StructField("rating", DoubleType()),
    StructField("ts", LongType()),
])
ITEM_SCHEMA = StructType([StructField("item_id", IntegerType()), StructField("title", StringType())])

RATING_SEP = "::"
POSTED_LINE_SEP = "\n"
POSTED_FIELD_SEP = ","


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Any Hadoop-readable path; a missing path fails in the reader, not on the driver."""
    return spark.read.text(path)


def _split(line: Column, sep: str) -> Column:
    # Spark's split takes a regex; escape the separator.
    return F.split(line, re.escape(sep))


def _apply_mode(parsed: DataFrame, reason: Column, cols: list[str], mode: str, what: str):
    """``parsed`` has ``_line`` and the typed columns; ``reason`` is NULL for a good line.

    The split array and typed fields are computed once per row in their own
    projections (Catalyst keeps a projection separate when merging it would
    repeat a non-trivial expression). Fail-fast is folded into every output
    column instead of a separate filter, so column pruning cannot skip the
    check.
    """
    judged = parsed.withColumn("_reason", reason)
    # Parsed rows pass through a one-row generator: a filter on a generator's
    # output stays above it, so later filters (``rating > 0``, a split, the
    # reject routing) read the computed columns instead of being rewritten
    # into copies of the whole parse (which Catalyst would otherwise push into
    # the scan or join below, evaluating the split once per reference).
    judged = judged.select(F.inline(F.array(F.struct(*judged.columns))))
    if mode == "failfast":
        err = F.raise_error(F.concat(F.lit(f"malformed {what} line ("), F.col("_reason"),
                                     F.lit("): "), F.coalesce("_line", F.lit(""))))
        return judged.select(*[F.when(F.col("_reason").isNull(), F.col(c)).otherwise(err).alias(c)
                               for c in cols])
    if mode == "quarantine":
        good = judged.where(F.col("_reason").isNull()).select(*cols)
        rejects = judged.where(F.col("_reason").isNotNull()).select(
            F.col("_line").alias("line"), F.col("_reason").alias("reason"))
        return good, rejects
    raise ValueError(f"mode must be 'failfast' or 'quarantine', not {mode!r}")


def _fields(lines: DataFrame, col: str, sep: str, extra=()) -> DataFrame:
    return lines.select(*extra, F.col(col).alias("_line"),
                        _split(py_strip(col), sep).alias("_f"))


def judge_ratings(lines: DataFrame, col: str = "value") -> DataFrame:
    """``(_line, user_id, item_id, rating, ts, _reason)`` of every line; the
    reason is NULL for a good one. One split a line."""
    parsed, reason = _rating_fields(lines, col)
    judged = parsed.withColumn("_reason", reason)
    return judged.select(F.inline(F.array(F.struct(
        "_line", "user_id", "item_id", "rating", "ts", "_reason"))))


def parse_ratings(lines: DataFrame, mode: str = "failfast", col: str = "value"):
    """Lines -> ``(user_id int, item_id int, rating double, ts bigint, bucket int)``.

    ``bucket`` is the last digit of ``ts`` (never negative). Extra fields are
    ignored. Ids outside int32 are rejected here rather than failing model fit.
    """
    parsed, reason = _rating_fields(lines, col)
    out = _apply_mode(parsed, reason, ["user_id", "item_id", "rating", "ts"], mode, "rating")
    if mode == "quarantine":
        return out[0].withColumn("bucket", ts_bucket("ts")), out[1]
    return out.withColumn("bucket", ts_bucket("ts"))


def _rating_fields(lines: DataFrame, col: str):
    f = F.col("_f")
    parsed = _fields(lines, col, RATING_SEP).select(
        "_line",
        F.size(f).alias("_n"),
        int_field(f, 1, "int").alias("user_id"),
        int_field(f, 2, "int").alias("item_id"),
        float_field(f, 3).alias("rating"),
        int_field(f, 4, "bigint").alias("ts"),
    )
    reason = (F.when(F.col("_n") < 4, F.lit("too few fields"))
              .when(F.col("user_id").isNull(), F.lit("user_id"))
              .when(F.col("item_id").isNull(), F.lit("item_id"))
              .when(F.col("rating").isNull(), F.lit("rating"))
              .when(F.col("ts").isNull(), F.lit("ts")))
    return parsed, reason


def load_positive_ratings(lines: DataFrame, mode: str = "failfast"):
    """Personal-ratings loader: parsed ratings with ``rating > 0`` only; NaN is
    not above zero (Spark orders it highest). Quarantine: (good, rejects)."""
    parsed = parse_ratings(lines, mode)
    good = parsed[0] if mode == "quarantine" else parsed
    good = good.where((F.col("rating") > 0) & ~F.isnan("rating"))
    return (good, parsed[1]) if mode == "quarantine" else good


def require_nonempty(df: DataFrame, what: str = "ratings") -> DataFrame:
    """Explicit emptiness check (one-row probe, not a count)."""
    if df.limit(1).count() == 0:
        raise ValueError(f"no {what} provided")
    return df


def parse_items(lines: DataFrame, mode: str = "failfast", col: str = "value"):
    """Lines -> ``(item_id int, title string)``; a title is cut at the separator."""
    f = F.col("_f")
    parsed = _fields(lines, col, RATING_SEP).select(
        "_line",
        F.size(f).alias("_n"),
        int_field(f, 1, "int").alias("item_id"),
        text_field(f, 2).alias("title"),
    )
    reason = (F.when(F.col("_n") < 2, F.lit("too few fields"))
              .when(F.col("item_id").isNull(), F.lit("item_id")))
    return _apply_mode(parsed, reason, ["item_id", "title"], mode, "item")


def parse_posted(bodies: DataFrame, user_col: str = "user_id", body_col: str = "body",
                 mode: str = "failfast", corrupt_col: str | None = None, extra=()):
    """Posted bodies (one per request: a user id and ``item,rating`` lines)
    -> ``(user_id, item_id, rating)`` rows, one per line, and the request's
    columns named in ``extra``.

    Nothing is dropped: a record that isn't JSON (``corrupt_col`` holds its
    text), a request without a body, and a user id that isn't an int32 literal
    are malformed like a bad line. A request's bad user rejects each of its lines.
    """
    corrupt = F.col(corrupt_col) if corrupt_col else F.lit(None).cast("string")
    lines = bodies.select(
        F.col(user_col).cast("string").alias("_user"), corrupt.alias("_corrupt"), *extra,
        F.explode_outer(_split(py_strip(body_col), POSTED_LINE_SEP)).alias("_body_line"))
    f = F.col("_f")
    parsed = _fields(lines, "_body_line", POSTED_FIELD_SEP,
                     extra=("_user", "_corrupt", *extra)).select(
        F.coalesce("_corrupt", "_line").alias("_line"), "_corrupt", *extra,
        F.col("_line").isNull().alias("_empty"),
        int_field(F.array("_user"), 1, "int").alias("user_id"),
        F.size(f).alias("_n"),
        int_field(f, 1, "int").alias("item_id"),
        float_field(f, 2).alias("rating"),
    )
    reason = (F.when(F.col("_corrupt").isNotNull(), F.lit("corrupt record"))
              .when(F.col("_empty"), F.lit("no body"))
              .when(F.col("user_id").isNull(), F.lit("user_id"))
              .when(F.col("_n") < 2, F.lit("too few fields"))
              .when(F.col("item_id").isNull(), F.lit("item_id"))
              .when(F.col("rating").isNull(), F.lit("rating")))
    return _apply_mode(parsed, reason, ["user_id", "item_id", "rating", *extra], mode, "posted")


def format_rating_lines(ratings: DataFrame) -> DataFrame:
    """The inverse of :func:`parse_ratings`: ``user::item::rating::ts`` text."""
    return ratings.select(F.concat_ws(RATING_SEP, *[F.col(c).cast("string") for c in
                                                    ("user_id", "item_id", "rating", "ts")])
                          .alias("value"))


def format_item_lines(items: DataFrame) -> DataFrame:
    return items.select(F.concat_ws(RATING_SEP, F.col("item_id").cast("string"),
                                    F.col("title")).alias("value"))
