"""Mixing sources to target weights by entropy balancing.

Every document gets a rate (expected copies) ``r = min(MOST, exp(l_s * c))``
with ``c`` its size over its source's mean size. Of all rates that meet the
token constraint ``sum(r * size) = target`` of the source these have the
largest entropy with no document above ``MOST`` copies; ``l_s`` solves the convex
dual. Its gradient and curvature are sums over documents, so a Newton step is
one distributed aggregation. Rates depend on (source, size) only: the sums run
over that histogram, built once with partial aggregation. A step that leaves
the bracket is replaced by its midpoint.

Rates become copies by error diffusion: a source is dealt by hash into blocks of
some ``BLOCK_ROWS`` rows; in a block, largest documents first, each takes the
whole number next to its rate that keeps the block's taken words closest to
what the rates ask. The smallest documents come last and even out the rest. A
hot source is many blocks, so no task holds it.

Targets: sources in code point order, null last, weigh 3, 1, 2, repeating, and
share ``SHARE`` of all words; none exceeds ``MOST`` times its source's words and
the excess goes to the others by weight (a water level over the sources).

Defined results: null and empty texts have size 0 and rate 1 (one copy, no
words); a source without words has target 0; repeated rows are dealt one by one
and equal rows are interchangeable; no rows give no rows. The source table (a
row each) is sorted in one task; nothing else is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from ratecraft.llm.common import n_words, ship_by_value, written

#: Weights of the sources, in turn.
WEIGHTS = (3, 1, 2)
#: Words of the mix over words of the corpus.
SHARE = 1.5
#: Most copies of a document.
MOST = 2
#: Newton stops when every source is this close to its target (relative).
CLOSE = 1e-7
STEPS = 100
BLOCK_ROWS = 4096
#: Rows of the source table that may be sent to every executor.
MOST_SOURCES = 100_000


def _key(source="source"):
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def targets(hist: DataFrame) -> DataFrame:
    """(key, n_rows, least, source_size, target) of each source."""
    per = hist.groupBy("key").agg(
        F.sum("n").alias("n_rows"), F.sum(F.col("n") * F.col("size")).alias("source_size"),
        F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"),
        F.sum(F.when(F.col("size") > 0, F.col("n"))).alias("n_full"))
    turn = (F.row_number().over(Window.orderBy(F.col("key") == "", "key")) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (turn + 1).cast("int"))
    per = per.withColumn("w", weight).withColumn("cap", F.lit(float(MOST)) * F.col("source_size"))
    # Sources reach their cap in the order of cap / weight. With those before
    # this one capped, the level is what is left over the weight that is left.
    order = Window.orderBy(F.col("cap") / F.col("w"), "key")
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.lit(SHARE) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) \
        / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    per = per.withColumn("level", level).withColumn("rank", F.row_number().over(order))
    free = F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct("rank", "level"))
    per = per.withColumn("water", F.min(free).over(every)["level"])
    return per.select("key", "n_rows", "n_full", "least", "source_size",
                      F.when(F.col("water").isNull(), F.col("cap"))
                      .otherwise(F.least(F.col("cap"), F.col("water") * F.col("w"))).alias("target"))


def _rate(l, c):
    return F.least(F.lit(float(MOST)), F.exp(F.least(l * c, F.lit(50.0))))


def balance(hist: DataFrame, goal: DataFrame) -> DataFrame:
    """``goal`` with ``mean`` and the dual variable ``l`` of each source."""
    s = goal.withColumn("mean", F.try_divide("source_size", "n_full"))
    share = F.try_divide("target", "source_size")
    least = F.try_divide("least", "mean")
    top = F.try_divide(F.log(F.lit(float(MOST))), least)  # here even the smallest document has all its copies
    full = share >= MOST * (1 - 1e-12)
    s = s.withColumns({
        "lo": F.when(share >= 1, F.lit(0.0)).otherwise(F.try_divide(F.log(share), least)),
        "hi": F.when(share >= 1, top).otherwise(F.lit(0.0)),
        "l": F.when(full, top).otherwise(F.log(share)),
        "off": F.when(full | (F.col("source_size") == 0), F.lit(0.0)).otherwise(F.lit(1.0)),
    })
    s = written(s, "dual")
    docs = hist.where("size > 0").select("key", "size", "n")
    for _ in range(STEPS):
        if not (s.agg(F.max("off")).first()[0] or 0) > CLOSE:
            break
        open_ = s.where(F.col("off") > CLOSE)
        c = F.try_divide("size", "mean")
        r = _rate(F.col("l"), c)
        words = F.col("n") * F.col("size")
        sums = docs.join(open_, "key").groupBy("key").agg(
            F.sum(words * r).alias("f"), F.sum(F.when(r < MOST, words * r * c).otherwise(0.0)).alias("df"))
        s = s.join(sums, "key", "left")
        miss = F.col("f") - F.col("target")
        lo = F.when(miss <= 0, F.col("l")).otherwise(F.col("lo"))
        hi = F.when(miss >= 0, F.col("l")).otherwise(F.col("hi"))
        s = s.withColumns({"lo": F.when(F.col("f").isNull(), F.col("lo")).otherwise(lo),
                           "hi": F.when(F.col("f").isNull(), F.col("hi")).otherwise(hi),
                           "off": F.when(F.col("f").isNull(), F.col("off")).otherwise(F.try_divide(F.abs(miss), F.col("target")))})
        step = F.col("l") - F.try_divide(miss, F.col("df"))
        inside = (F.col("df") > 0) & (step > F.col("lo")) & (step < F.col("hi"))
        s = s.withColumn("l", F.when(F.col("f").isNull() | (F.col("off") <= CLOSE), F.col("l"))
                         .when(inside, step).otherwise((F.col("lo") + F.col("hi")) / 2)).drop("f", "df")
        s = written(s, "dual")
    return s


def _diffuse(batches):
    """Rows sorted by (block, size descending): adds ``copies``."""
    block, owed = None, 0.0
    for b in batches:
        size, rate, at = (b.column(c).to_numpy() for c in ("mix_size", "mix_rate", "mix_block"))
        copies = np.zeros(b.num_rows, np.int64)
        for i in range(b.num_rows):
            if at[i] != block:
                block, owed = at[i], 0.0
            low = int(rate[i])
            owed += (rate[i] - low) * size[i]
            up = low < MOST and owed > size[i] / 2
            if up:
                owed -= size[i]
            copies[i] = low + up
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(copies)], names=[*b.schema.names, "mix_copies"])


def with_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with ``mix_size, mix_source_size, mix_target, mix_copies``
    (columns of ``docs`` that begin with ``mix_`` are replaced)."""
    docs = docs.drop(*[c for c in docs.columns if c.lower().startswith("mix_")])
    hist = written(docs.select(_key().alias("key"), n_words(F.col("text")).alias("size"))
                   .groupBy("key", "size").agg(F.count("*").alias("n")), "sizes")
    dual = balance(hist, written(targets(hist), "targets"))
    dual = dual.select(F.col("key").alias("mix_key"), F.col("source_size").alias("mix_source_size"),
                       F.col("target").alias("mix_target"), F.col("mean").alias("mix_mean"), F.col("l").alias("mix_l"),
                       F.ceil(F.col("n_rows") / BLOCK_ROWS).alias("mix_blocks"))
    if dual.count() <= MOST_SOURCES:
        dual = F.broadcast(dual)
    rows = docs.withColumn("mix_key", _key()).join(dual, "mix_key")
    deal = F.xxhash64(F.col("doc_id"), F.col("text"))
    rows = rows.withColumns({
        "mix_size": n_words(F.col("text")), "mix_deal": deal,
        "mix_block": F.xxhash64("mix_key", F.pmod(deal, F.col("mix_blocks")))})
    rows = rows.withColumn("mix_rate", F.when(F.col("mix_size") == 0, F.lit(1.0)).otherwise(
        _rate(F.col("mix_l"), F.try_divide("mix_size", "mix_mean"))))
    rows = rows.drop("mix_key", "mix_mean", "mix_l", "mix_blocks").repartition("mix_block") \
        .sortWithinPartitions("mix_block", F.desc("mix_size"), "mix_deal")
    schema = StructType([*rows.schema.fields, StructField("mix_copies", LongType())])
    return rows.mapInArrow(_diffuse, schema).drop("mix_deal", "mix_block", "mix_rate")


def mix_report(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` and ``copies``."""
    # Texts only tell repeated ids apart, so their hash stands in for them.
    d = with_copies(docs.select("doc_id", "text", "source"))
    return d.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
                    F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
                    F.col("mix_copies").alias("copies"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: each row as many times as its copies, columns unchanged."""
    kept = [F.col(f"`{c}`") for c in docs.columns]
    names = [c for c in docs.columns if c.lower().startswith("mix_")]
    if names:  # keep them out of the way
        kept = [F.col(f"`own_{c}`").alias(c) if c in names else F.col(f"`{c}`") for c in docs.columns]
        docs = docs.withColumnsRenamed({c: f"own_{c}" for c in names})
    d = with_copies(docs).where("mix_copies > 0")
    return d.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies")))).select(*kept)


ship_by_value(__name__)
