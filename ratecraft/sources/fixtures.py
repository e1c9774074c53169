"""Rating-shaped tables derived in-plan from the TPC-H-style test tables.

The reference reads rating and title text files that are not shipped; these
stand in for them (definitions in FIXTURES.md). Every table here is a plain
DataFrame over the given parquet files, so its size grows with theirs and
Catalyst prunes the columns each query needs.

- ``ratings_all``: one rating per lineitem: user = order's customer, item = part,
  rating = floor(quantity / 10), ts = order date in epoch seconds plus a
  per-line offset.
- ``base``: everyone but the personal user (the ratings file stand-in).
- ``personal``: the personal user's rows (the personal-ratings file; the loader
  keeps ``rating > 0``).
- ``items``: part key and name.
- ``user_factors`` / ``item_factors``: explicit factor vectors from ``embeddings``;
  every fifth vector is a user's, so both sides grow with the table.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .text import format_item_lines, format_rating_lines

# Fixed values of the fixture definition.
PERSONAL_USER = 0
USER_FACTOR_EVERY = 5
TS_OFFSET_MOD = 86400
_EPOCH_NTZ = _dt.datetime(1970, 1, 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Orders of the personal user that are broadcast at most.
MOST_BROADCAST = 100_000


def _ordered_lines(spark: SparkSession, sf_dir: str, *order_cols: str) -> DataFrame:
    """Line items with their order's columns. Both tables are dealt by order key
    once, at every size: the test table is one file, and per-row work downstream
    should not follow its splits; AQE splits a hot order's rows. The orders of a
    partition, a fourth of its lines, are hashed: sorting the lines takes more memory."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    od = table(spark, sf_dir, "orders").select("o_orderkey", *order_cols)
    return li.join(od.hint("shuffle_hash"), li.l_orderkey == od.o_orderkey)


def _as_ratings(lines: DataFrame) -> DataFrame:
    epoch_s = F.timestamp_diff("SECOND", F.lit(_EPOCH_NTZ).cast("timestamp_ntz"),
                               F.col("o_orderdate"))
    return lines.select(
        F.col("o_custkey").cast("int").alias("user_id"),
        F.col("l_partkey").cast("int").alias("item_id"),
        F.floor(F.col("l_quantity") / 10).cast("double").alias("rating"),
        (epoch_s + (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % TS_OFFSET_MOD)
        .cast("bigint").alias("ts"),
    )


def ratings_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_ratings(_ordered_lines(spark, sf_dir, "o_custkey", "o_orderdate"))


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratings_all(spark, sf_dir).where(F.col("user_id") != PERSONAL_USER)


def personal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal user's rows, zeros included (the loader drops them). Their
    few orders go to the line items, which then are not shuffled."""
    mine = table(spark, sf_dir, "orders").where(F.col("o_custkey").cast("int") == PERSONAL_USER) \
        .select("o_orderkey", "o_custkey", "o_orderdate")
    if mine.limit(MOST_BROADCAST + 1).count() > MOST_BROADCAST:
        return ratings_all(spark, sf_dir).where(F.col("user_id") == PERSONAL_USER)
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    return _as_ratings(li.join(F.broadcast(mine), li.l_orderkey == mine.o_orderkey))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("item_id"),
                                                F.col("p_name").alias("title"))


def ratings_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings file stand-in: base ratings as ``user::item::rating::ts`` lines."""
    return format_rating_lines(base(spark, sf_dir))


def all_rating_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_rating_lines(ratings_all(spark, sf_dir))


def spoiled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base lines with two in five changed by the rule FIXTURES.md gives:
    one kind for each way to be malformed, and lines that are odd but good."""
    sep = "::"
    u, i, r, t = (F.col(c).cast("string") for c in ("user_id", "item_id", "rating", "ts"))
    kind = F.pmod(F.col("user_id") * 7 + F.col("item_id") * 3 + F.col("ts"), F.lit(20))
    join = lambda *f: F.concat_ws(sep, *f)
    line = (F.when(kind == 0, join(u, i, r))
            .when(kind == 1, join(F.concat(F.lit("u"), u), i, r, t))
            .when(kind == 2, join(u, F.concat(i, F.lit(".0")), r, t))
            .when(kind == 3, join(u, i, F.lit("five"), t))
            .when(kind == 4, join(u, i, r, F.concat(t, F.lit("e0"))))
            .when(kind == 5, F.concat(F.lit(" \t"), join(u, i, r, t), F.lit("  ")))
            .when(kind == 6, join(u, i, r, t, F.lit("more")))
            .when(kind == 7, join(u, i, r, F.concat(F.lit("-"), t)))
            .otherwise(join(u, i, r, t)))
    return base(spark, sf_dir).select(line.alias("value"))


def odd_rating_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rating lines; the rating of every 17th timestamp is ``nan``."""
    r = F.when(F.pmod("ts", F.lit(17)) == 0, F.lit("nan")).otherwise(F.col("rating").cast("string"))
    return ratings_all(spark, sf_dir).select(F.concat_ws(
        "::", F.col("user_id").cast("string"), F.col("item_id").cast("string"), r,
        F.col("ts").cast("string")).alias("value"))


def spoiled_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON record per line item (``value``), some spoiled by the rule
    FIXTURES.md gives: not JSON, no body, a user outside int32, bad lines."""
    rows = _ordered_lines(spark, sf_dir, "o_custkey")
    kind = F.pmod(F.col("l_orderkey") * 3 + F.col("l_partkey") + F.col("l_linenumber"), F.lit(16))
    part = F.col("l_partkey").cast("string")
    stars = F.floor(F.col("l_quantity") / 10).cast("bigint").cast("string")
    line = (F.when(kind == 3, part).when(kind == 4, F.concat_ws(",", F.concat(F.lit("p"), part), stars))
            .when(kind == 5, F.concat_ws(",", part, F.lit("high"))).otherwise(F.concat_ws(",", part, stars)))
    user = F.when(kind == 2, F.concat(F.lit("99999"), F.lpad(F.col("o_custkey").cast("string"), 7, "0"))) \
        .otherwise(F.col("o_custkey").cast("string"))
    good = F.concat(F.lit('{"user_id": '), user, F.lit(', "body": "'), line, F.lit('"}'))
    value = (F.when(kind == 0, F.concat(F.lit("post "), part, F.lit(" {")))
             .when(kind == 1, F.concat(F.lit('{"user_id": '), user, F.lit("}"))).otherwise(good))
    return rows.select(value.alias("value"))


def personal_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_rating_lines(personal_rows(spark, sf_dir))


def item_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item-titles file stand-in: ``item::title`` lines."""
    return format_item_lines(items(spark, sf_dir))


def posted_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One posted request per order: the customer posts ``part,rating`` lines.

    A request is a bounded thing (an order has a handful of lines); the body is
    built per (order, block of 8 line numbers) so even an order with huge line
    counts yields bounded bodies.
    """
    lines = _ordered_lines(spark, sf_dir, "o_custkey").select(
        "o_orderkey", "o_custkey", (F.col("l_linenumber") / 8).cast("bigint").alias("blk"),
        F.concat_ws(",", F.col("l_partkey").cast("string"),
                    F.floor(F.col("l_quantity") / 10).cast("bigint").cast("string"))
        .alias("line"))
    return lines.groupBy("o_orderkey", "blk", "o_custkey").agg(
        F.concat_ws("\n", F.collect_list("line")).alias("body")
    ).select(F.col("o_custkey").cast("int").alias("user_id"), "body")


def named_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One posted line per line item, with a request id of its own."""
    rows = _ordered_lines(spark, sf_dir, "o_custkey")
    same = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_quantity")
    return rows.select(
        F.col("o_custkey").cast("int").alias("user_id"),
        F.concat_ws(",", F.col("l_partkey").cast("string"),
                    F.floor(F.col("l_quantity") / 10).cast("bigint").cast("string")).alias("body"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", F.row_number().over(same)).alias("request_id"))


def user_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.where(F.pmod("vec_id", F.lit(USER_FACTOR_EVERY)) == 0).select(
        F.col("vec_id").cast("int").alias("user_id"), F.col("embedding").alias("features"))


def item_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.where(F.pmod("vec_id", F.lit(USER_FACTOR_EVERY)) != 0).select(
        F.col("vec_id").cast("int").alias("item_id"), F.col("embedding").alias("features"))
