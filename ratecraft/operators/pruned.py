"""Exact top-N by dot product that skips what can't win.

Items are dealt by vector norm into bands, longest first (cut at quantiles, so
band 0 holds about one item in ``2 ** (BANDS - 1)``, and each next band twice as
many). Every user is scored against band 0. By Cauchy-Schwarz no item of a
later band scores more than ``|user| * (longest norm of the band)``; so a user
whose N-th best score so far is above that is not scored against the band, nor
against any later one. The rest of the user's bands go through the same block
scorer as :func:`.topn.top_n_by_dot`, with the same rows: equal scores by item
id, rated items left out before ranking, no cap. The bound is widened by a
relative 1e-9, far beyond rounding, and a user with fewer than N candidates
skips nothing.

How much is skipped depends on the norms: :func:`pruning_report` counts it. With
norms all alike nothing is skipped, and the cost is one more shuffle of the users.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions.vectors import vector_dim
from ..session import scratch_path
from .exclusions import user_blocks_within
from .topn import (GROUP_BUDGET_BYTES, _BLOCK_OUT, _block_scorer, block_size, plan_blocks, top_n_per_group, user_block,
                   with_sets)

BANDS = 7
_WIDER = 1 + 1e-9


def _norm(col="features"):
    squares = F.transform(col, lambda x: x.cast("double") * x.cast("double"))
    return F.sqrt(F.aggregate(squares, F.lit(0.0).cast("double"), lambda acc, x: acc + x))


class _Bands:
    """Band of each norm, and per band the number of items, longest norm, blocks."""

    def __init__(self, items: DataFrame, bands: int):
        norms = items.select("norm")
        shares = [1 - 2.0 ** -k for k in range(bands - 1, 0, -1)]
        cuts = norms.agg(F.percentile_approx("norm", shares, 10_000)).first()[0] if shares else None
        self.cuts = sorted(cuts or [], reverse=True)
        found = {r["band"]: r for r in norms.groupBy(self.of("norm").alias("band")).agg(
            F.count(F.lit(1)).alias("n"), F.max("norm").alias("longest")).collect()}  # a row a band
        self.names = sorted(found)
        self.sizes = [found[b]["n"] for b in self.names]
        self.longest = [found[b]["longest"] for b in self.names]

    def of(self, norm: str):
        return sum((F.when(F.col(norm) < c, 1).otherwise(0) for c in self.cuts), F.lit(0))

    def number(self, rows: int):
        """Blocks of at most about ``rows`` items: the first block of each band, and the end."""
        self.blocks = [-(-n // rows) for n in self.sizes]
        self.first = [0, *np.cumsum(self.blocks).tolist()]

    def block(self):
        """The block of an item, by its norm and a hash of its id inside the band."""
        inside = F.lit(None).cast("int")
        for k, b in enumerate(self.names):
            inside = F.when(self.of("norm") == b, F.lit(self.first[k]) + F.pmod(
                F.xxhash64("item_id"), F.lit(self.blocks[k])).cast("int")).otherwise(inside)
        return inside

    def reached(self):
        """Bands after the first that a user (``norm``, ``floor``) can gain from;
        the longest norms fall, so these are the next ones."""
        gains = (F.when(F.col("floor").isNull() | (F.col("norm") * (m * _WIDER) >= F.col("floor")), 1).otherwise(0)
                 for m in self.longest[1:])
        return sum(gains, F.lit(0))


def _prepared(user_factors, item_factors, bands):
    users = user_factors.where(F.col("features").isNotNull()).select("user_id", "features", _norm().alias("norm"))
    items = item_factors.where(F.col("features").isNotNull()).select("item_id", "features", _norm().alias("norm"))
    return users, items, _Bands(items, bands)


def _phases(user_factors, item_factors, n, exclude, bands):
    """(bands, users with floor and ``reached``, scored rows of both phases)."""
    spark = user_factors.sparkSession
    users, items, plan = _prepared(user_factors, item_factors, bands)
    if not plan.names:
        return plan, None, None
    n_users, rank = users.count(), vector_dim(item_factors, default=1)
    nu, ni = plan_blocks(n_users, sum(plan.sizes), spark.sparkContext.defaultParallelism,
                         block_size(rank), block_size(rank))
    plan.number(-(-sum(plan.sizes) // ni))
    blocked = items.select("item_id", "features", plan.block().alias("ib"))
    if exclude is not None:
        blocked, seen = with_sets(blocked, exclude)
        nu = user_blocks_within(seen, nu, GROUP_BUDGET_BYTES, n_users)
    ub = user_block(nu).alias("ub")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def scored(dealt: DataFrame, low: int, high: int) -> DataFrame:
        """Users (with the blocks ``from`` to ``upto``) against the items of blocks low to high - 1."""
        asked = dealt.select("user_id", "features", "floor", ub, F.explode(F.sequence("from", "upto")).alias("ib"))
        if exclude is not None:
            asked = asked.join(seen, ["user_id", "ib"], "left")
        else:
            asked = asked.withColumn("seen", F.lit(None).cast("binary"))
        offered = blocked.where((F.col("ib") >= low) & (F.col("ib") < high)).select(
            F.explode(F.sequence(F.lit(0), F.lit(nu - 1))).alias("ub"), "ib", "item_id", "features")
        p = min(parts, nu * (high - low))
        return asked.select("ub", "ib", "user_id", "features", "seen", "floor").repartition(p, "ub", "ib") \
            .groupBy("ub", "ib").cogroup(offered.repartition(p, "ub", "ib").groupBy("ub", "ib")) \
            .applyInArrow(_block_scorer(n), schema=_BLOCK_OUT)

    none = F.lit(None).cast("double").alias("floor")
    band0 = plan.first[1]
    start = users.select("user_id", "features", none, F.lit(0).alias("from"), F.lit(band0 - 1).alias("upto"))
    # Read twice below (floors, and rows of the result), so written once.
    path = scratch_path(spark, "pruned-first")
    top_n_per_group(scored(start, 0, band0), n).write.parquet(path)
    best = spark.read.parquet(path)
    floors = best.where(F.col("rank") == n).select("user_id", F.col("score").alias("floor"))
    judged = users.join(floors, "user_id", "left").withColumn("reached", plan.reached())
    rows = best.drop("rank")
    if len(plan.names) > 1:
        ends = F.array(*[F.lit(x) for x in plan.first[1:]])
        more = judged.where("reached > 0").select(
            "user_id", "features", "floor", F.lit(band0).alias("from"),
            (F.get(ends, F.col("reached")) - 1).alias("upto"))
        rows = rows.unionByName(scored(more, band0, plan.first[-1]))
    return plan, judged, rows


def top_n_pruned(user_factors: DataFrame, item_factors: DataFrame, n: int, exclude: DataFrame | None = None,
                 bands: int = BANDS) -> DataFrame:
    """``(user_id, rank, item_id, score)``, the rows of :func:`.topn.top_n_by_dot`."""
    _, _, rows = _phases(user_factors, item_factors, n, exclude, bands)
    if rows is None:
        return user_factors.sparkSession.createDataFrame([], "user_id int, rank int, item_id int, score double")
    return top_n_per_group(rows, n).select("user_id", "rank", "item_id", "score")


def pruning_report(user_factors: DataFrame, item_factors: DataFrame, n: int, exclude: DataFrame | None = None,
                   bands: int = BANDS) -> DataFrame:
    """``(band, n_items, longest, n_users)``: how many users each band is scored
    for; a pair is skipped where its user isn't counted."""
    spark = user_factors.sparkSession
    plan, judged, _ = _phases(user_factors, item_factors, n, exclude, bands)
    if judged is None:
        return spark.createDataFrame([], "band int, n_items long, longest double, n_users long")
    counts = judged.agg(*[F.count_if(F.col("reached") >= k) for k in range(len(plan.names))]).first()
    return spark.createDataFrame(
        [(k, plan.sizes[k], plan.longest[k], counts[k]) for k in range(len(plan.names))],
        "band int, n_items long, longest double, n_users long")
