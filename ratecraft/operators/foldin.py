"""Fold-in: user vectors for fixed item vectors, without a refit.

For each user the ALS half step is solved exactly,

    (sum_i v_i v_i' + reg_param * n I) x = sum_i r_i v_i,

over the ``n`` ratings the user gave to items the model knows (the weighting of
``pyspark.ml`` ALS with explicit ratings; a pair rated twice counts twice).

Plan. Ratings meet the item vectors by a plain equi-join (which AQE can split at
a hot item). Each task then combines what it holds: a user with more rows in an
Arrow batch than a summed matrix is wide (about half the rank) sends one row
with the packed upper triangle, the right side and the count; others send their
rows as they are. So a user with a third of all ratings sends one short row a
batch, and nobody's shuffle grows. After the shuffle by user the rows come
sorted, sums run on from batch to batch (one matrix in hand at a time), and the
finished users of a batch are solved together by a batched Cholesky.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Bytes of outer products held at once inside a task.
PRODUCT_BYTES = 32 << 20


def _functions(rank: int, reg_param: float, product_bytes: int):
    # The returned functions run in the Python workers. They refer only to
    # numpy, pyarrow and plain values bound here, so executors need nothing
    # from this package installed.
    upper = np.triu_indices(rank)
    width = len(upper[0])
    packed = width + rank + 1            # triangle, right side, count
    rows_at_once = max(1, product_bytes // (8 * packed))

    def matrix(column):
        flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        if len(values) != len(flat) * rank:
            raise ValueError("factor length mismatch")
        return values.reshape(len(flat), rank)

    def sums(v, r, start):
        """Packed sums of the rows from each start to the next."""
        out = np.zeros((len(start), packed))
        edge = np.append(start, len(v))
        owner = np.repeat(np.arange(len(start)), np.diff(edge))
        for lo in range(0, len(v), rows_at_once):
            part, own = v[lo:lo + rows_at_once], owner[lo:lo + rows_at_once]
            rows = np.concatenate([part[:, upper[0]] * part[:, upper[1]], part * r[lo:lo + rows_at_once, None],
                                   np.ones((len(part), 1))], axis=1)
            at = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            out[own[at]] += np.add.reduceat(rows, at, axis=0)
        return out

    def combine(batches):
        """Rows (user, vector, rating) or, for users with many, one packed sum."""
        for b in batches:
            if not b.num_rows:
                continue
            user = b.column("user_id").to_numpy()
            order = np.argsort(user, kind="stable")
            user = user[order]
            v, r = matrix(b.column("features"))[order], b.column("rating").to_numpy().astype(np.float64)[order]
            if not (np.isfinite(r).all() and np.isfinite(v).all()):
                raise ValueError("a rating or an item factor is not finite")
            start = np.flatnonzero(np.append(True, user[1:] != user[:-1]))
            size = np.diff(np.append(start, len(user)))
            many = np.repeat(size * (rank + 1) > packed, size)
            few = ~many
            values = np.concatenate([np.concatenate([v[few], r[few, None]], axis=1).reshape(-1),
                                     sums(v[many], r[many], np.flatnonzero(np.append(True, np.diff(user[many]) != 0)))
                                     .reshape(-1) if many.any() else np.zeros(0)])
            heads = user[start][size * (rank + 1) > packed]
            length = np.concatenate([np.full(few.sum(), rank + 1), np.full(len(heads), packed)])
            offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([user[few], heads]).astype(np.int32)),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["user_id", "terms"])

    def total(b):
        """(users, packed sums) of one batch, users rising."""
        user = b.column("user_id").to_numpy()
        terms = b.column("terms")
        length = np.diff(np.asarray(terms.offsets))
        values = terms.flatten().to_numpy()
        at = np.concatenate([[0], np.cumsum(length)])[:-1]
        start = np.flatnonzero(np.append(True, user[1:] != user[:-1]))
        owner = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(user))))
        out = np.zeros((len(start), packed))
        raw = np.flatnonzero(length == rank + 1)
        if len(raw):
            rows = values[at[raw][:, None] + np.arange(rank + 1)]
            first = np.flatnonzero(np.append(True, owner[raw][1:] != owner[raw][:-1]))
            out[owner[raw][first]] += sums(rows[:, :rank], rows[:, rank], first)
        for k in np.flatnonzero(length == packed):
            out[owner[k]] += values[at[k]:at[k] + packed]
        return user[start], out

    def cholesky_solve(a, b):
        """Solves every symmetric positive definite system of a stack."""
        low = np.linalg.cholesky(a)
        x = b.copy()
        for i in range(rank):
            x[:, i] = (x[:, i] - (low[:, i, :i] * x[:, :i]).sum(axis=1)) / low[:, i, i]
        for i in range(rank - 1, -1, -1):
            x[:, i] = (x[:, i] - (low[:, i + 1:, i] * x[:, i + 1:]).sum(axis=1)) / low[:, i, i]
        return x

    def solved(user, total_rows):
        vectors = np.empty((len(user), rank), np.float32)
        step = max(1, product_bytes // (16 * rank * rank))
        for lo in range(0, len(user), step):
            t = total_rows[lo:lo + step]
            a = np.zeros((len(t), rank, rank))
            a[:, upper[0], upper[1]] = t[:, :width]
            a[:, upper[1], upper[0]] = t[:, :width]
            a[:, np.arange(rank), np.arange(rank)] += reg_param * t[:, -1:]
            vectors[lo:lo + step] = cholesky_solve(a, t[:, width:width + rank])
        offsets = np.arange(len(user) + 1, dtype=np.int32) * rank
        return pa.RecordBatch.from_arrays(
            [pa.array(user.astype(np.int32)), pa.array(total_rows[:, -1].astype(np.int64)),
             pa.ListArray.from_arrays(pa.array(offsets), pa.array(vectors.reshape(-1)))],
            names=["user_id", "n_ratings", "features"])

    def solve(batches):
        """Batches sorted by user: sums run on, finished users are solved."""
        held_user, held = None, None
        for b in batches:
            if not b.num_rows:
                continue
            user, rows = total(b)
            if held_user is not None:
                if user[0] == held_user:
                    rows[0] += held
                else:
                    user, rows = np.append(held_user, user), np.concatenate([held[None], rows])
            if len(user) > 1:
                yield solved(user[:-1], rows[:-1])
            held_user, held = user[-1], rows[-1].copy()
        if held_user is not None:
            yield solved(np.array([held_user]), held[None])

    return combine, solve


def fold_in_users(ratings: DataFrame, item_factors: DataFrame, reg_param: float, rank: int | None = None) -> DataFrame:
    """``(user_id, n_ratings, features)``: each user's vector for the given items.

    ``ratings(user_id, item_id, rating)``, ``item_factors(item_id, features)``.
    Ratings of unknown items don't count; a user without a known item gets no
    row (the cold start "drop"). ``reg_param`` must be positive (the systems are
    then positive definite). A null, NaN or infinite rating fails the job.
    """
    if not reg_param > 0:
        raise ValueError("reg_param must be positive")
    if rank is None:
        from ..functions.vectors import vector_dim
        rank = vector_dim(item_factors, default=1)
    combine, solve = _functions(rank, float(reg_param), PRODUCT_BYTES)
    known = F.when(F.col("rating").isNull(), F.raise_error(F.lit("a rating is null"))).otherwise(F.col("rating"))
    rows = ratings.select(F.col("user_id").cast("int"), "item_id", known.cast("double").alias("rating")) \
        .join(item_factors.where(F.col("features").isNotNull()).select("item_id", "features"), "item_id") \
        .select("user_id", "rating", F.col("features").cast("array<double>").alias("features"))
    return rows.mapInArrow(combine, "user_id int, terms array<double>") \
        .repartition("user_id").sortWithinPartitions("user_id") \
        .mapInArrow(solve, "user_id int, n_ratings long, features array<float>")
