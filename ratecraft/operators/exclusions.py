"""Items a user must not be offered, as compressed sets per item block.

Items are numbered inside their block, 0, 1, ... in order of their ids, so a
(user, block) set is a set of small numbers and is stored in the smallest of
three containers:

* array: the numbers, 2 bytes each (4 where a block has more than 65,536 items);
* runs: (first, length - 1) pairs, twice that a pair;
* bitmap: a bit a number, up to the largest.

One byte in front names the container and its width. Sets are built by a
partial aggregation (each task sends one set a user and block), so a user with
many ratings costs at most the block's bits. :func:`max_group_bytes` counts what
the sets of a user block really take, which bounds the block scorer's memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

_ARRAY, _RUNS, _BITMAP, _WIDE = 0, 1, 2, 4


def numbered(items: DataFrame) -> DataFrame:
    """Adds ``pos`` to ``items(item_id, ib, ...)``: the rank of the id in its
    block (a bounded group, by the choice of the number of blocks)."""
    return items.withColumn("pos", F.dense_rank().over(Window.partitionBy("ib").orderBy("item_id")) - 1)


def _codec():
    # Functions for Python workers; they refer to numpy, pyarrow and each other only.
    array, runs, bitmap, wide = _ARRAY, _RUNS, _BITMAP, _WIDE

    def encode_one(pos):
        """Bytes of a set given as sorted different numbers."""
        top = int(pos[-1])
        kind = wide if top >= 1 << 16 else 0
        dtype = np.dtype("<u4" if kind else "<u2")
        first = np.flatnonzero(np.append(True, np.diff(pos) != 1))
        sizes = {array: len(pos) * dtype.itemsize, runs: 2 * len(first) * dtype.itemsize, bitmap: top // 8 + 1}
        best = min(sizes, key=lambda k: (sizes[k], k))
        if best == array:
            body = pos.astype(dtype).tobytes()
        elif best == runs:
            length = np.diff(np.append(first, len(pos)))
            body = np.stack([pos[first], length - 1], axis=1).astype(dtype).tobytes()
        else:
            bits = np.zeros(top + 1, np.uint8)
            bits[pos] = 1
            body = np.packbits(bits, bitorder="little").tobytes()
        return bytes([kind | best]) + body

    def decode_one(blob):
        """The sorted numbers of a set."""
        kind, wide_too = blob[0] & 3, blob[0] & wide
        if kind == bitmap:
            return np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, offset=1), bitorder="little"))
        values = np.frombuffer(blob, "<u4" if wide_too else "<u2", offset=1).astype(np.int64)
        if kind == array:
            return values
        first, length = values[0::2], values[1::2] + 1
        upto = np.cumsum(length)
        return np.arange(upto[-1]) - np.repeat(upto - length, length) + np.repeat(first, length)

    return encode_one, decode_one


def _encoder():
    encode_one, _ = _codec()

    def run(batches):
        for b in batches:
            sets = b.column("at")
            values, offsets = sets.flatten().to_numpy(), np.asarray(sets.offsets)
            offsets = offsets - offsets[0]
            blobs = [encode_one(values[a:z]) for a, z in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([b.column("user_id"), b.column("ib"), pa.array(blobs, pa.binary())],
                                             names=["user_id", "ib", "seen"])

    return run


def _decoder():
    _, decode_one = _codec()

    def run(batches):
        for b in batches:
            sets = [decode_one(x) for x in b.column("seen").to_pylist()]
            n = [len(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(b.column("user_id").to_numpy(), n)), pa.array(np.repeat(b.column("ib").to_numpy(), n)),
                 pa.array(np.concatenate([*sets, np.zeros(0)]).astype(np.int32))], names=["user_id", "ib", "pos"])

    return run


def excluded_sets(exclude: DataFrame, numbers: DataFrame) -> DataFrame:
    """``(user_id, ib, seen)``: the sets of ``exclude(user_id, item_id)`` over
    ``numbers(item_id, ib, pos)``; other items don't count."""
    rows = exclude.select(F.col("user_id").cast("int"), "item_id").where("user_id is not null") \
        .join(numbers.select("item_id", "ib", "pos"), "item_id")
    return rows.groupBy("user_id", "ib").agg(F.sort_array(F.collect_set("pos")).alias("at")) \
        .mapInArrow(_encoder(), "user_id int, ib int, seen binary")


def excluded_pairs(sets: DataFrame, numbers: DataFrame) -> DataFrame:
    """``(user_id, item_id)`` back from the sets."""
    return sets.mapInArrow(_decoder(), "user_id int, ib int, pos int") \
        .join(numbers.select("item_id", "ib", "pos"), ["ib", "pos"]).select("user_id", "item_id")


def max_group_bytes(sets: DataFrame, user_blocks: int) -> int:
    """Bytes of the sets in the largest (user block, item block)."""
    from .topn import user_block
    group = sets.groupBy(user_block(user_blocks).alias("ub"), "ib").agg(F.sum(F.length("seen")).alias("n"))
    return group.agg(F.max("n")).first()[0] or 0


def user_blocks_within(sets: DataFrame, user_blocks: int, most: int, n_users: int) -> int:
    """The least doubling of ``user_blocks`` with which no block's sets take more
    than ``most`` bytes (or each user has a block)."""
    while user_blocks < n_users and max_group_bytes(sets, user_blocks) > most:
        user_blocks = min(2 * user_blocks, max(1, n_users))
    return user_blocks
