"""Helpers shared by the corpus operators.

Functions that run in Python workers live in modules registered for pickling
by value, so executors need numpy, pyarrow and PySpark only.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratecraft.session import scratch_path

#: One word: a run without space, tab, newline, vertical tab, form feed, return.
WORD_SPLIT = r"[\x20\x09-\x0D]+"


def ship_by_value(module: str) -> None:
    """Pickle this module's functions whole, so that executors need no install."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor costs a reread of files, not a rerun of
    what made them. The schema is given, so an empty table reads back too.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Keys that may count as hot in one join.
HOT_KEYS = 1024


def met(rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``values`` (one row a ``key``; its column
    ``n``: how many of ``rows`` hold that key); nulls where there is no value.

    A key with more than 1 / ``HOT_KEYS`` of all rows is hot. Fewer keys than
    that can be, whatever the input, so their values are broadcast, and their
    rows are dealt over the tasks of the join that serves all other keys.
    """
    names = [c for c in values.columns if c not in (key, "n")]
    # Read from the files, the salt stays a join key; a literal would become a filter.
    values = written(values.withColumn("cool_salt", F.lit(0).cast("long")), "values")
    total = values.agg(F.sum("n")).first()[0] or 0
    value = F.struct(*names)
    hot = values.where(F.col("n") * HOT_KEYS > total).select(F.col(key).alias("hot_key"), value.alias("hot_value"))
    cool = values.where(F.col("n") * HOT_KEYS <= total) \
        .select(F.col(key).alias("cool_key"), "cool_salt", value.alias("cool_value"))
    # Copies of one row differ by the task that holds them.
    spread = F.xxhash64(F.spark_partition_id(), *rows.columns).bitwiseOR(F.lit(1))
    out = rows.join(F.broadcast(hot), F.col(key) == F.col("hot_key"), "left") \
        .withColumn("met_salt", F.when(F.col("hot_key").isNull() & F.col(key).isNotNull(), F.lit(0).cast("long"))
                    .otherwise(spread))
    out = out.join(cool, (F.col(key) == F.col("cool_key")) & (F.col("met_salt") == F.col("cool_salt")), "left")
    return out.select(*rows.columns, *[F.when(F.col("hot_key").isNotNull(), F.col(f"hot_value.{c}"))
                                       .otherwise(F.col(f"cool_value.{c}")).alias(c) for c in names])


def words(text) -> F.Column:
    """The words of ``text`` as an array; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_SPLIT), "")


def n_words(text) -> F.Column:
    return F.size(words(text)).cast("long")


# --- UTF-8 text columns as numpy arrays -------------------------------------

#: Text bytes handled at once inside a task; one longer text is handled alone.
SLICE_BYTES = 1 << 20


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; null reads as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not (pa.types.is_string(col.type) or pa.types.is_binary(col.type)
            or pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)):
        col = col.cast(pa.string())
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if large else np.int32)
    off = off[col.offset:col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if col.null_count:
        # Null slots may cover bytes: give them none by repacking.
        lengths = np.diff(off)
        valid = np.asarray(col.is_valid())
        if lengths[~valid].any():
            raw = np.concatenate([raw[a:b] for a, b, ok in zip(off[:-1], off[1:], valid, strict=True)
                                  if ok] or [np.zeros(0, np.uint8)])
            return raw, np.concatenate([[0], np.cumsum(np.where(valid, lengths, 0))])
    return raw[off[0]:off[-1]], off - off[0]


def text_slices(col: pa.Array, most: int = SLICE_BYTES):
    """Yield (first row, last row + 1, bytes, offsets) in pieces of about ``most`` bytes."""
    raw, off = text_buffers(col)
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + most, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi


_WS = np.zeros(256, bool)
_WS[[0x20, 9, 10, 11, 12, 13]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: One random 64-bit value a byte, made by the rule above from 1..256.
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_STEP = np.uint64(0xD6E8FEB86659FD93)


#: Also cuts at ASCII punctuation and control characters.
PLAIN = _WS.copy()
PLAIN[[c for c in range(128) if not chr(c).isalnum()]] = True


def fold_case(data: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and, in UTF-8, for the capitals from U+00C0 to U+00DE."""
    out = _LOWER[data].astype(np.uint8)
    if len(data) > 1:
        at = np.flatnonzero(data[:-1] == 0xC3) + 1
        at = at[(data[at] >= 0x80) & (data[at] <= 0x9E) & (data[at] != 0x97)]
        out[at] += 0x20
    return out


def hash_words(data: np.ndarray, off: np.ndarray, lower: bool, cut: np.ndarray = _WS):
    """Words of concatenated texts; ``cut`` marks the bytes between words.

    Returns (64-bit hash of each word, byte start of each word, index of each
    text's first word with one more at the end).
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    blank = cut[data]
    first = np.empty(n, bool)
    first[0] = True
    first[1:] = blank[:-1]
    inner = off[:-1]
    first[inner[inner < n]] = True
    first &= ~blank
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, np.zeros(len(off), np.int64)
    at = np.cumsum(first)[starts[0]:] - 1
    pos = np.arange(starts[0], n, dtype=np.int64) - starts[at]
    longest = int(pos.max()) + 1
    power = np.cumprod(np.full(longest, _STEP, np.uint64))
    value = (_BYTE_LOWER if lower else _BYTE)[data[starts[0]:]] * power[pos]
    value[blank[starts[0]:]] = 0
    h = mix64(np.add.reduceat(value, starts - starts[0]))
    return h, starts, np.searchsorted(starts, off)


def hash_shingles(h: np.ndarray, woff: np.ndarray, k: int):
    """Hashes of every run of ``k`` words inside one text.

    A text with fewer words gives one hash for its whole sequence, one without
    words none. Returns (hashes, index of each text's first hash + the end).
    """
    count = np.diff(woff)
    runs = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    soff = np.concatenate([[0], np.cumsum(runs)])
    out = np.zeros(int(soff[-1]), np.uint64)
    text = np.repeat(np.arange(len(count)), runs)
    at = woff[:-1][text] + (np.arange(len(out)) - soff[:-1][text])
    width = np.minimum(count, k)[text]
    factor = np.uint64(0x9E3779B97F4A7C15)
    for j in range(k):
        use = width > j
        out[use] = out[use] * factor + h[at[use] + j]
        out[use] ^= out[use] >> np.uint64(29)
    return mix64(out + width.astype(np.uint64)), soff


def as_long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def as_hash(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.uint64)


def crc32_of_id(doc_id) -> F.Column:
    """crc32 of a doc_id written as text (null id: of the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


ship_by_value(__name__)
