"""Dot products over factor vectors (``array<float>``), computed in double."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MAX_UNROLL = 256


def vector_dim(df: DataFrame, col: str = "features", default: int | None = None) -> int:
    """Dimension of a factor column, read from one row (a single-row action).
    Without vectors: ``default``, or an error."""
    row = df.select(F.size(col).alias("d")).where(F.col(col).isNotNull()).first()
    if row is None:
        if default is not None:
            return default
        raise ValueError(f"no vectors in column {col!r}")
    return int(row["d"])


def dot(a: Column | str, b: Column | str, dim: int | None = None) -> Column:
    """Sum of element products, added in element order.

    With ``dim`` known (up to ``MAX_UNROLL``) the sum is unrolled into ``dim``
    codegen'd terms, about 3x faster than higher-order functions; otherwise a
    ``zip_with``/``aggregate`` form gives the same sum. In either form vectors
    of different lengths, or of another length than ``dim``, fail the task
    rather than yield a wrong score.
    """
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    differ = F.size(a) != F.size(b)
    if dim is not None:
        differ = differ | (F.size(a) != dim)
    if dim is None or dim > MAX_UNROLL:
        # Past a few hundred terms the unrolled expression outgrows codegen's
        # method-size limit; the compact form stays compiled at any length.
        prods = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
        total = F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, x: acc + x)
    else:
        total = None
        for i in range(dim):
            term = F.get(a, F.lit(i)).cast("double") * F.get(b, F.lit(i)).cast("double")
            total = term if total is None else total + term
    return F.when(differ, F.raise_error(F.lit("factor length mismatch"))).otherwise(total)


def finite(score: Column) -> Column:
    """``score``, or a failed task where it is NaN or infinite."""
    bad = F.isnan(score) | (F.abs(score) == float("inf"))
    return F.when(bad, F.raise_error(F.lit(
        "a score is not finite: the factors hold NaN or infinity"))).otherwise(score)
