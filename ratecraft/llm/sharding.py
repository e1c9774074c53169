"""Two-pass external shuffle into shards.

Pass 1 scatters: a shard is the one whose seeded hash with the document id is
largest (rendezvous hashing), so adding a shard moves rows only into the new
one; inside a shard a second seeded hash of id and text deals rows evenly into
buckets of about ``BUCKET_BYTES``. Pass 2 puts each bucket into a fixed order,
shuffles it by Fisher-Yates with a generator seeded by (seed, shard, bucket),
and writes it as Parquet, a folder a shard. A lost task is simply rerun: bucket,
order and shuffle depend on the rows alone. A slot is the bucket's offset in its
shard plus the place in the bucket; offsets come from the files' row counts.

Defined results: null texts count as empty (crc32 0, size 8); null ids share one
shard; ids that repeat share a shard, and are dealt over its buckets by text;
equal rows are interchangeable; an empty table writes an empty folder; of the
documents' columns only ``shard`` and ``slot`` are replaced, all others are kept
(names used inside give way to theirs).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from ratecraft.llm.common import ship_by_value, written
from ratecraft.session import scratch_path

SHARDS = 24
SEED = 20_240_601
#: Text bytes of a bucket; a task holds one bucket at a time.
BUCKET_BYTES = 8 << 20
ADDED = ("shard", "slot")


def _inner(columns) -> list[str]:
    """Names for the bucket, the place in it, the deal and the offset that none
    of ``columns`` has."""
    taken, names = {c.lower() for c in columns}, []
    for name in ("bucket", "place", "deal", "offset"):
        while name in taken:
            name += "_"
        names.append(name)
    return names


def _score(s):
    return F.xxhash64(F.lit(SEED), F.col("doc_id"), s)


def shard_of(shards: int):
    """The shard of ``doc_id`` among ``shards``."""
    each = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)),
                       lambda s: F.struct(_score(s).alias("h"), s.alias("s")))
    return F.array_max(each)["s"].cast("int")


def fisher_yates(n: int, seed: list[int]) -> np.ndarray:
    """A uniform permutation of 0..n-1: swap each place, last first, with one
    drawn from those up to it."""
    order = list(range(n))
    draw = np.random.Generator(np.random.PCG64(seed)).integers(0, np.arange(n, 0, -1), dtype=np.int64).tolist()
    for i, j in zip(range(n - 1, 0, -1), draw, strict=False):
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def _shuffle_buckets(bucket: str, place: str):
    """Rows sorted by (shard, bucket, ...): each bucket shuffled, with its places."""
    def shuffled(held, key):
        t = pa.Table.from_batches(held)
        order = fisher_yates(t.num_rows, [SEED, *key])
        t = t.take(pa.array(order)).append_column(place, pa.array(np.arange(t.num_rows)))
        return t.to_batches(max_chunksize=2048)

    def run(batches):
        held, key = [], None
        for b in batches:
            if not b.num_rows:
                continue
            ks = np.stack([b.column("shard").to_numpy(), b.column(bucket).to_numpy()], axis=1)
            cuts = [0, *(np.flatnonzero((ks[1:] != ks[:-1]).any(axis=1)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                now = tuple(int(x) for x in ks[lo])
                if key is not None and now != key:
                    yield from shuffled(held, key)
                    held = []
                key = now
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from shuffled(held, key)

    return run


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ADDED])
    bucket, place, deal, _ = _inner(docs.columns)
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8)).first()[0] or 0
    buckets = max(1, -(-size // (shards * BUCKET_BYTES)))
    rows = docs.withColumns({
        "shard": shard_of(shards),
        deal: F.xxhash64(F.lit(SEED + 1), F.col("doc_id"), F.col("text")),
    }).withColumn(bucket, F.pmod(F.col(deal), F.lit(buckets)).cast("int"))
    rows = rows.repartition("shard", bucket).sortWithinPartitions("shard", bucket, deal, "doc_id")
    schema = StructType([*rows.schema.fields, StructField(place, LongType())])
    out = rows.mapInArrow(_shuffle_buckets(bucket, place), schema).drop(deal)
    out.sortWithinPartitions("shard", bucket, place).write.partitionBy("shard").parquet(path)


#: Buckets whose offsets may be sent to every executor.
MOST_BUCKETS = 1_000_000


def read_shards(spark, path: str, schema, keep=None) -> DataFrame:
    """The rows of written shards with ``shard`` and ``slot``; ``schema``: of
    the documents. ``keep``: what to make of their columns, before the join
    with the offsets, so that it moves no texts."""
    fields = [f for f in schema.fields if f.name.lower() not in ADDED]
    bucket, place, _, offset = _inner([f.name for f in fields])
    full = StructType([*fields, StructField(bucket, IntegerType()), StructField(place, LongType()),
                       StructField("shard", IntegerType())])
    rows = spark.read.schema(full).parquet(path)
    counts = rows.groupBy("shard", bucket).count()
    before = Window.partitionBy("shard").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(counts.select("shard", bucket, F.coalesce(F.sum("count").over(before), F.lit(0)).alias(offset)),
                      "offsets")
    if offsets.count() <= MOST_BUCKETS:
        offsets = F.broadcast(offsets)
    rows = rows.select(*([F.col(f"`{f.name}`") for f in fields] if keep is None else keep), "shard", bucket, place)
    return rows.join(offsets, ["shard", bucket]).withColumn("slot", F.col(offset) + F.col(place)) \
        .drop(offset, place, bucket)


def sharded(docs: DataFrame, shards: int = SHARDS, keep=None) -> DataFrame:
    """Write ``docs`` into shards below the shared folder and read them back."""
    spark = docs.sparkSession
    path = scratch_path(spark, "shards")
    write_shards(docs, path, shards)
    return read_shards(spark, path, docs.schema, keep)


def shard_report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of each row,
    from the files."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = sharded(docs.select("doc_id", "text"), shards, [
        F.col("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32")])
    # With one more shard a row either stays or goes to the new one.
    grown = F.when(_score(F.lit(shards)) > _score(F.col("shard")), F.lit(shards)).otherwise(F.col("shard"))
    return d.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot",
                    grown.cast("int").alias("grown_shard"))


ship_by_value(__name__)
