"""Top-N operators.

* :func:`top_n` - one ordered limit (TakeOrderedAndProject: a per-task heap,
  then N rows per task to the driver side).
* :func:`top_n_per_group` - ``row_number`` window; Spark adds a partial
  WindowGroupLimit before the shuffle, so each task sends at most N rows per key.
* :func:`top_n_by_dot` - exact top-N items per user by factor dot product
  without materialising user x item pairs as rows. Users and items are hashed
  into blocks of bounded size; block pair (ub, ib) meets in one cogroup where
  numpy scores it, longest items first and no further than an item can still win
  (:func:`_block_scorer`), and keeps each user's best N. Every block pair is
  bounded (block sizes follow a memory budget and the factor rank, and for
  rated items what their sets take), however big either table grows. Items a
  user already rated ride on the user's row, a compressed set per item block
  (:mod:`.exclusions`), and are masked before ranking: no over-fetch and no cap.

One rule for scores in every path: the products are added in factor order in
double precision, equal scores go to the smaller id, and a score that is not
finite fails the job (a model with NaN or infinite factors is broken).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import (DoubleType, IntegerType, StructField, StructType)

from ..session import scratch_path
from .exclusions import _codec, excluded_sets, numbered, user_blocks_within


def _order(score: str, tie: str) -> list[Column]:
    # Highest score first; equal scores by ascending id (deterministic ties).
    return [F.col(score).desc(), F.col(tie).asc()]


def top_n(df: DataFrame, n: int, score: str = "score", tie: str = "item_id") -> DataFrame:
    """Global top-N with a 1-based ``rank`` column."""
    top = df.orderBy(*_order(score, tie)).limit(n)
    w = Window.orderBy(*_order(score, tie))
    # The window runs over at most n rows (after the limit).
    return top.withColumn("rank", F.row_number().over(w))


def top_n_per_group(df: DataFrame, n: int, group: str = "user_id", score: str = "score",
                    tie: str = "item_id") -> DataFrame:
    w = Window.partitionBy(group).orderBy(*_order(score, tie))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


_BLOCK_OUT = StructType([
    StructField("user_id", IntegerType()),
    StructField("item_id", IntegerType()),
    StructField("score", DoubleType()),
])


def _block_scorer(n: int, max_chunk: int = 2048, most_rated: int = 1 << 22):
    """Each user's ``n`` best items of a block, as a cogroup function on Arrow tables
    ``users(user_id, features, seen[, floor])`` and ``items(item_id, features)``.

    Items come longest first, a step of them at a time for a chunk of users. A
    single-precision product of unit vectors preselects: what is further below the
    user's ``n``-th best so far (or their ``floor``) than its rounding can't win.
    The rest gets the exact sum. A user is done when, by Cauchy-Schwarz, the longest
    item left can't reach that score either.
    """
    # The returned function runs in the Python workers. It refers only to
    # numpy, pyarrow and plain values bound here, so it is shipped by value and
    # executors need nothing from this package installed.
    step_pairs = SCORE_CHUNK_BYTES // 4
    wider = 1 + 1e-9
    _, decode = _codec()

    def in_order(u, v):
        # The sum every other path computes: factor by factor, no BLAS.
        acc = u[:, 0] * v[:, 0]
        for d in range(1, u.shape[1]):
            acc = acc + u[:, d] * v[:, d]
        return acc

    def matrix(column):
        lists = column.combine_chunks()
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
        if (lengths != lengths[0]).any():
            raise ValueError("factor length mismatch")
        return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), int(lengths[0]))

    def lengths_of(x):
        most = np.abs(x).max(axis=1, initial=0.0)
        return most * np.linalg.norm(x / np.where(most > 0, most, 1.0)[:, None], axis=1)

    def score_block(users: pa.Table, items: pa.Table) -> pa.Table:
        out_u, out_i, out_s = [], [], []

        def result():
            return pa.table({"user_id": np.concatenate([*out_u, np.zeros(0)]).astype(np.int32),
                             "item_id": np.concatenate([*out_i, np.zeros(0)]).astype(np.int32),
                             "score": np.concatenate([*out_s, np.zeros(0)])})

        if not users.num_rows or not items.num_rows:
            return result()
        umat, imat = matrix(users["features"]), matrix(items["features"])
        if umat.shape[1] != imat.shape[1]:
            raise ValueError("factor length mismatch")
        not_finite = ValueError("a score is not finite: the factors hold NaN or infinity")
        if not (np.isfinite(umat).all() and np.isfinite(imat).all()):
            raise not_finite
        user_ids = users["user_id"].to_numpy().astype(np.int64)
        seen = users["seen"].combine_chunks()
        outer = np.full(len(user_ids), -np.inf)
        if "floor" in users.column_names:
            given = users["floor"].to_numpy().astype(np.float64)   # none: NaN
            outer = np.where(np.isnan(given), -np.inf, given)
        ulen, ilen = lengths_of(umat), lengths_of(imat)
        by_length = np.argsort(-ilen, kind="stable")
        imat, ilen = imat[by_length], ilen[by_length]
        item_ids = items["item_id"].to_numpy().astype(np.int64)[by_length]
        n_items, longest = len(item_ids), ilen[0]
        if not np.isfinite(ulen.max() * longest):
            for at in range(0, n_items, 1024):   # factors this large: each score is looked at
                for start in range(0, len(user_ids), 1024):
                    if not np.isfinite(umat[start:start + 1024] @ imat[at:at + 1024].T).all():
                        raise not_finite
        # A rated item's number is its rank among the block's ids (an id may repeat).
        ranked, rank = np.unique(item_ids, return_inverse=True)
        at_rank = np.argsort(rank, kind="stable")
        first = np.searchsorted(rank[at_rank], np.arange(len(ranked) + 1))
        k = min(n, n_items)
        units = (imat / (longest or 1.0)).astype(np.float32)
        # No single-precision product of unit vectors is further than this from the sum in order.
        eps = (umat.shape[1] + 4) * 2.0 ** -23

        def places(numbers):
            """Places in ``item_ids`` of the items with these numbers."""
            if len(ranked) == n_items:
                return at_rank[numbers]
            count = first[numbers + 1] - first[numbers]
            within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            return at_rank[np.repeat(first[numbers], count) + within]

        def rated_by(row):
            found = seen[int(row)].as_py()
            return places(decode(found)) if found is not None else None

        def chunks(rows):
            """Chunks of users with their rated pairs (row of the chunk, place of the item), by place."""
            held, r, c, total = [], [], [], 0
            for row in rows:
                rated = rated_by(row) if some_seen else None
                if rated is not None:
                    r.append(np.full(len(rated), len(held)))
                    c.append(rated)
                    total += len(rated)
                held.append(row)
                if len(held) == max_chunk or total >= most_rated:
                    yield np.array(held), r, c
                    held, r, c, total = [], [], [], 0
            if held:
                yield np.array(held), r, c

        some_seen = seen.null_count < len(seen)
        # Vectors of zeros: every score is zero, so the smallest ids win.
        none = np.flatnonzero((ulen == 0) | (longest == 0))
        for row in none[outer[none] <= 0]:
            rated = rated_by(row)
            front = at_rank[:k + (0 if rated is None else len(rated))]
            best = (front if rated is None else front[~np.isin(front, rated)])[:k]
            out_u.append(np.full(len(best), user_ids[row]))
            out_i.append(item_ids[best])
            out_s.append(in_order(np.repeat(umat[row][None], len(best), axis=0), imat[best]))

        for rows, r, c in chunks(np.flatnonzero((ulen > 0) & (longest > 0))):
            m, u, size, least = len(rows), umat[rows], ulen[rows], outer[rows]
            unit = (u / size[:, None]).astype(np.float32)
            rated_r, rated_c = (np.concatenate(r), np.concatenate(c)) if r else (np.zeros(0, int), np.zeros(0, int))
            in_place = np.argsort(rated_c, kind="stable")
            rated_r, rated_c = rated_r[in_place], rated_c[in_place]
            top_s, top_i = np.full((m, k), -np.inf), np.full((m, k), -1)
            active, at = np.arange(m), 0
            while at < n_items:
                known = np.maximum(least[active], top_s[active, k - 1])
                reach = size[active] * (ilen[at] * wider) >= known
                active, known = active[reach], known[reach]
                if not len(active):
                    break
                upto = min(n_items, at + max(512, min(16384, step_pairs // len(active))))
                s = (unit if len(active) == m else unit[active]) @ units[at:upto].T
                a, z = np.searchsorted(rated_c, [at, upto])
                if z > a:
                    row_of = np.full(m, -1)
                    row_of[active] = np.arange(len(active))
                    hit = row_of[rated_r[a:z]]
                    s[hit[hit >= 0], rated_c[a:z][hit >= 0] - at] = -np.inf
                off = eps * ilen[at] / longest + 1e-37
                enough = known / size[active] / longest - off
                fresh = np.flatnonzero(known == -np.inf)
                if len(fresh) and upto - at >= k:
                    few = s if len(fresh) == len(s) else s[fresh]
                    enough[fresh] = np.partition(few, upto - at - k, axis=1)[:, upto - at - k] - 2 * off
                enough = np.nextafter(enough.astype(np.float32), np.float32(-np.inf))
                hit = np.flatnonzero(s.max(axis=1) >= enough)
                if len(hit):
                    near = s[hit]
                    x, y = np.nonzero((near >= enough[hit][:, None]) & (near > -np.inf))
                    x, y = active[hit[x]], y + at
                    sc = in_order(u[x], imat[y])
                    last = top_s[x, k - 1]
                    better = (sc >= least[x]) & ((sc > last) | ((sc == last) & (item_ids[y] < item_ids[top_i[x, k - 1]])))
                    x, y, sc = x[better], y[better], sc[better]
                    if len(x):
                        # With what the same users had: by (row, score desc, item id asc), first k per row.
                        who = x[np.append(True, x[1:] != x[:-1])]
                        held_r, held_k = np.nonzero(top_i[who] >= 0)
                        held_r = who[held_r]
                        x, y, sc = (np.concatenate([held_r, x]), np.concatenate([top_i[held_r, held_k], y]),
                                    np.concatenate([top_s[held_r, held_k], sc]))
                        order = np.lexsort((item_ids[y], -sc, x))
                        x, y, sc = x[order], y[order], sc[order]
                        place = np.arange(x.size) - np.searchsorted(x, x, side="left")
                        keep = place < k
                        top_s[x[keep], place[keep]], top_i[x[keep], place[keep]] = sc[keep], y[keep]
                at = upto
            found, place = np.nonzero(top_i >= 0)
            out_u.append(user_ids[rows[found]])
            out_i.append(item_ids[top_i[found, place]])
            out_s.append(top_s[found, place])
        return result()

    return score_block


# Memory budget per side of a block pair (float64 factor rows), and block
# size limits. Shipped volume is about U x I x rank x (1/item_block +
# 1/user_block), so blocks are as large as the budget allows: at rank 64 a
# block holds 65,536 rows (32 MB), a user is shipped once per 65,536 items.
# A step's single-precision scores should stay in a core's cache.
GROUP_BUDGET_BYTES = 32 << 20
SCORE_CHUNK_BYTES = 4 << 20
MIN_BLOCK, MAX_BLOCK = 1024, 1 << 18


def block_size(rank: int) -> int:
    """Rows per block for factors of length ``rank`` within the budget."""
    return int(min(MAX_BLOCK, max(MIN_BLOCK, GROUP_BUDGET_BYTES // (max(1, rank) * 8))))


def user_block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("user_id"), F.lit(blocks)).cast("int")


def plan_blocks(n_users: int, n_items: int, parallelism: int,
                user_block: int, item_block: int,
                groups_per_core: int = 8) -> tuple[int, int]:
    """Block counts: never more rows per block than the block sizes (memory
    bound), and at least ``groups_per_core`` block pairs per core when the
    tables are small (so no core idles behind one big group)."""
    nu = max(1, math.ceil(n_users / user_block))
    ni = max(1, math.ceil(n_items / item_block))
    target = groups_per_core * max(1, parallelism)
    # More user blocks first: each more item block would give every user one more list.
    nu = max(nu, min(math.ceil(target / ni), math.ceil(n_users / MIN_BLOCK)))
    if nu * ni < target:
        f = math.sqrt(target / (nu * ni))
        nu = min(max(1, n_users), math.ceil(nu * f))
        ni = min(max(1, n_items), math.ceil(ni * f))
    return nu, ni


def with_sets(items: DataFrame, exclude: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``items(item_id, features, ib)`` numbered in their blocks, and the sets of
    ``exclude`` over them, both written."""
    spark = items.sparkSession
    path = scratch_path(spark, "top-n")
    numbered(items).write.parquet(f"{path}/items")
    items = spark.read.parquet(f"{path}/items")
    excluded_sets(exclude, items).write.parquet(f"{path}/sets")
    return items, spark.read.parquet(f"{path}/sets")


def top_n_by_dot(user_factors: DataFrame, item_factors: DataFrame, n: int,
                 exclude: DataFrame | None = None, user_blocks: int | None = None,
                 item_blocks: int | None = None,
                 sized_from: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``(user_id, rank, item_id, score)``: each user's N best items by dot product.

    ``user_factors(user_id, features)``, ``item_factors(item_id, features)``;
    ``exclude(user_id, item_id)`` removes pairs (e.g. already rated) before
    ranking. Filter ``item_factors`` first (popularity floor) to rank only
    eligible items. Block counts come from counts of ``sized_from`` (the plain
    factor tables, when the given ones are filtered: counting those would run
    their filters once more); with ``exclude`` there are as many user blocks as
    keep the sets of any block within the budget, by their exact sizes. The
    items in their blocks and the sets are written to the shared folder once,
    and read where they are needed again.
    """
    spark = user_factors.sparkSession
    nu, ni, n_users = user_blocks, item_blocks, None
    if nu is None or ni is None:
        from ..functions.vectors import vector_dim
        su, si = sized_from or (user_factors, item_factors)
        rank, n_users = vector_dim(su, default=1), su.count()
        pu, pi = plan_blocks(n_users, si.count(), spark.sparkContext.defaultParallelism,
                             block_size(rank), block_size(rank))
        nu, ni = nu or pu, ni or pi
    items = item_factors.where(F.col("features").isNotNull()).select(
        "item_id", "features", F.pmod(F.xxhash64("item_id"), F.lit(ni)).cast("int").alias("ib"))
    seen = None
    if exclude is not None:
        items, seen = with_sets(items, exclude)
        if user_blocks is None:
            nu = user_blocks_within(seen, nu, GROUP_BUDGET_BYTES, n_users)

    users = (user_factors.where(F.col("features").isNotNull())
             .select("user_id", "features", user_block(nu).alias("ub"),
                     F.explode(F.sequence(F.lit(0), F.lit(ni - 1))).alias("ib")))
    if seen is not None:
        users = users.join(seen, ["user_id", "ib"], "left")
    else:
        users = users.withColumn("seen", F.lit(None).cast("binary"))
    items = items.select(F.explode(F.sequence(F.lit(0), F.lit(nu - 1))).alias("ub"), "ib", "item_id", "features")

    # Scoring cost grows with block *products* while bytes grow with block
    # sums, so AQE's byte-based coalescing would pack all block pairs into a
    # few tasks. An explicit partition count (not coalesced) keeps every core
    # busy; both sides share it, so the cogroup adds no further shuffle.
    parts = min(nu * ni, max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                             spark.sparkContext.defaultParallelism))
    scored = (users.select("ub", "ib", "user_id", "features", "seen")
              .repartition(parts, "ub", "ib").groupBy("ub", "ib")
              .cogroup(items.repartition(parts, "ub", "ib").groupBy("ub", "ib"))
              .applyInArrow(_block_scorer(n), schema=_BLOCK_OUT))
    return top_n_per_group(scored, n).select("user_id", "rank", "item_id", "score")
