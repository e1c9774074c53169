"""Joins on a key that a large share of the rows may have.

AQE splits a skewed partition only where both sides are plain shuffles; where
one side is an aggregate by the key (titles, counts), all rows of a hot key go to
one task. :func:`salted_join` deals the rows of hot keys over several tasks and
copies the other side's row of that key, and of no other, to each of them.

Hot keys come from a heavy-hitter sketch (``approx_top_k``: a fixed number of
tracked keys a task, merged to one row of at most ``HOT_KEYS`` keys), so finding
them needs no shuffle of the keys, whatever their number. The sketch tracks
``TRACKED`` keys, which finds every key with more than about 0.1 % of the rows.
It decides the speed only: a key that it misses, or counts wrongly, joins as any
other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

HOT_KEYS, TRACKED = 128, 4096
#: Rows of one key that one task may take.
SLICE_ROWS = 1 << 20


def hot_keys(df: DataFrame, key: str, slice_rows: int = SLICE_ROWS) -> dict:
    """Keys with more than ``slice_rows`` rows -> tasks to deal them over."""
    found = df.select(F.col(key).alias("k")).where("k is not null").select(F.expr(f"approx_top_k(k, {HOT_KEYS}, {TRACKED})")).first()[0]
    return {r["item"]: -(-r["count"] // slice_rows) for r in found or [] if r["count"] > slice_rows}


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner",
                hot: dict | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``left.join(right, key, how)`` for ``how`` inner or left, evenly dealt.

    ``right`` should hold few rows a key (it is copied for hot keys). ``hot`` are
    the :func:`hot_keys` of ``left``, or of any table with the same hot keys;
    they are looked for in ``left`` if not given. Rows of a left join without a
    key match nothing and are dealt out too.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"salted_join does not do {how!r}")
    hot = hot_keys(left, key, slice_rows) if hot is None else hot
    if not hot and how == "inner":
        return left.join(right, key)
    salt = _fresh("salt", left.columns + right.columns)
    kind = left.schema[key].dataType
    pairs = [x for k, n in hot.items() for x in (F.lit(k).cast(kind), F.lit(int(n)))]
    known = F.create_map(*pairs) if pairs else F.lit(None).cast(f"map<{kind.simpleString()},int>")
    # Copies of one row differ by the task that holds them.
    spread = F.xxhash64(F.spark_partition_id(), *[c for c in left.columns if c != key
                                                  and left.schema[c].dataType.typeName() not in ("map", "variant")])
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = F.when(F.col(key).isNull(), F.lit(parts)).otherwise(F.coalesce(F.element_at(known, F.col(key)), F.lit(1)))
    dealt = left.withColumn(salt, F.pmod(spread, tasks).cast("int"))
    copied = right.withColumn(salt, F.explode(F.sequence(
        F.lit(0), F.coalesce(F.element_at(known, F.col(key)), F.lit(1)) - 1)))
    return dealt.join(copied, [key, salt], how).drop(salt)


def _fresh(name: str, taken) -> str:
    taken = {c.lower() for c in taken}
    while name in taken:
        name += "_"
    return name
