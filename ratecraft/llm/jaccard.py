"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures.

Links two texts when the Jaccard similarity of their sets of word shingles is
at least ``num / den``. The steps, each one a Spark job over all rows:

1. Every text becomes its sorted set of 64-bit shingle hashes; a 64-bit hash of
   that set names its class, so equal sets are one class from here on. A class
   has a size and a parity bitmap: bit ``h mod BITS`` flips for each shingle.
   The same pass counts shingles in a table of ``CELLS`` cells.
2. Two similar sets must share ``l`` of the first ``n - ceil(t n) + l`` shingles
   of any common order, with ``l`` about ``n / SHARED``, the smaller of the two.
   The order puts shingles from crowded cells last; it decides the speed, never
   the result. Those shingles are the tile keys.
3. Tiles: the classes of one key, sorted by size. Pairs whose sizes differ by
   more than the threshold allows are not formed (the size band), and the bit
   count of the two bitmaps' difference bounds the overlap from above:
   ``|A & B| <= (|A| + |B| - bits(A xor B)) / 2``, first with bitmaps folded to
   ``BITS``, then, for pairs met under ``l`` keys, with the whole ones. Tiles of one key above
   ``TILE`` rows are dealt into pairs of blocks, so no task holds a hot key.
4. Pairs that pass are settled exactly by intersecting the sorted sets; pairs
   of classes already found in one component are spared.

Large groups of near copies are contracted first: each class of a tile with
``STAR`` or more rows is settled against the tile's smallest class. Jaccard
distance is a metric, so a class further than twice the threshold distance from
that hub can't link to a class that links to the hub, and classes already in
one component need no further comparison. What is left of a large tile is
contracted ``NEAREST`` times more, by default once, before pairs are formed: each class names the
one partner of another component that its bitmap puts nearest, these pairs (one
a class) are settled, and what they join is one component from then on. So a
group whose members lie around the threshold doesn't turn into all its pairs.

Defined results: null, empty and blank texts have an empty set and link with
nothing; a text of fewer than ``k`` words has its whole sequence as one
shingle; rows with a null id keep it, and take the smallest id of their
component (null if it has none); repeated rows stay, one result row each; other
columns are not read. Set and class identity rest on 64-bit hashes: the chance
of any false merge among a billion texts is about 3 %.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ratecraft.llm.common import (
    as_long,
    hash_shingles,
    hash_words,
    met,
    mix64,
    ship_by_value,
    text_slices,
    written,
)
from ratecraft.llm.components import components

#: Bits of the folded signature that travels with every tile row, and the
#: least of a whole one.
BITS = 512
#: One in so many of a set's shingles must be among the keys it shares.
SHARED = 32
#: Cells of the table that orders shingles by how common they are.
CELLS = 1 << 18
#: Rows of a tile side; a key with more rows is dealt into pairs of blocks.
TILE = 1024
#: A tile with so many rows is first settled against its hub.
STAR = 256
#: Rounds in which the classes of such tiles are settled with their nearest; they
#: decide the speed only.
NEAREST = 1


def _sets(col, k):
    """(row, sorted distinct shingle hashes) for each text with words."""
    for lo, _, data, off in text_slices(col):
        h, _, woff = hash_words(data, off, lower=True)
        s, soff = hash_shingles(h, woff, k)
        for i in np.flatnonzero(np.diff(soff)):
            yield lo + int(i), np.unique(s[soff[i]:soff[i + 1]])


def _class_of(s: np.ndarray) -> np.uint64:
    spread = mix64(s * np.uint64(0xA24BAED4963EE407))
    return mix64(np.array([np.add.reduce(spread) + np.uint64(len(s))], np.uint64))[0]


def _bitmap(s: np.ndarray) -> np.ndarray:
    """One bit a shingle or more (a power of two), as words of 64."""
    width = max(BITS, 1 << (len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _folded(words: np.ndarray, n: int = BITS // 64) -> np.ndarray:
    while len(words) > n:
        words = words[:len(words) // 2] ^ words[len(words) // 2:]
    return words


def _describe(k):
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()),
                        ("cls", pa.int64()), ("n", pa.int64()), ("bits", pa.binary()),
                        ("wide", pa.binary()), ("cells", pa.binary())])

    def run(batches):
        cells = np.zeros(CELLS, np.int64)
        seen = False
        for b in batches:
            seen = True
            m = b.num_rows
            cls, n, bits, wide = np.zeros(m, np.int64), np.zeros(m, np.int64), [None] * m, [None] * m
            for i, s in _sets(b.column("text"), k):
                w = _bitmap(s)
                cls[i], n[i] = as_long(np.array([_class_of(s)]))[0], len(s)
                bits[i], wide[i] = _folded(w).tobytes(), w.tobytes()
                cells += np.bincount((s >> np.uint64(46)).astype(np.int64), minlength=CELLS) \
                    if len(s) > CELLS // 8 else 0
                if len(s) <= CELLS // 8:
                    np.add.at(cells, (s >> np.uint64(46)).astype(np.int64), 1)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(m, pa.int64()), b.column("doc_id").cast(pa.int64()), b.column("text_key"),
                 pa.array(cls), pa.array(n), pa.array(bits, pa.binary()), pa.array(wide, pa.binary()),
                 pa.nulls(m, pa.binary())], schema=schema)
        if seen:
            parts = cells.astype(np.float32).reshape(64, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(64)), *[pa.nulls(64, pa.int64())] * 4, *[pa.nulls(64, pa.binary())] * 2,
                 pa.array([x.tobytes() for x in parts], pa.binary())], schema=schema)

    return run


def _sum_cells(batches):
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            v = np.frombuffer(x, np.float32)
            total[i] = total[i] + v if i in total else v
    yield pa.RecordBatch.from_pydict({"row": pa.array(list(total), pa.int64()),
                                      "cells": pa.array([v.tobytes() for v in total.values()], pa.binary())})


def _crowding(described: DataFrame) -> np.ndarray:
    """How crowded each cell is: 0 up to four times the mean, then its log2.
    ``CELLS`` bytes, whatever the input."""
    parts = described.where("cells is not null").select("row", "cells").repartition(16, "row")
    rows = parts.mapInArrow(_sum_cells, "row long, cells binary").collect()
    cells = np.zeros((64, CELLS // 64))
    for r in rows:
        cells[r.row] = np.frombuffer(r.cells, np.float32)
    cells = cells.ravel()
    load = cells / max(cells.mean(), 1e-9)
    return np.where(load < 4, 0, np.minimum(np.log2(np.maximum(load, 1)) * 4, 255)).astype(np.uint8)


def _keys(k, num, den, crowd):
    def run(batches):
        level = crowd.value
        seen = set()  # one entry a text of this task: copies give their keys once a task
        for b in batches:
            key, cls, size = [], [], []
            for _, s in _sets(b.column("text"), k):
                c = _class_of(s)
                if c in seen:
                    continue
                seen.add(c)
                n = len(s)
                p = n - (num * n + den - 1) // den + max(1, n // SHARED)
                lv = level[(s >> np.uint64(46)).astype(np.int64)]
                if lv.any():
                    s = s[np.lexsort((s, lv))]
                key.append(s[:p])
                cls.append(np.full(p, c, np.uint64))
                size.append(np.full(p, n, np.int64))
            if key:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(as_long(np.concatenate(key))), pa.array(as_long(np.concatenate(cls))),
                     pa.array(np.concatenate(size))], names=["key", "cls", "n"])

    return run


def _bits_of(col) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint64).reshape(-1, BITS // 64)


def _settle(k):
    """Rows sorted by (a, kind): the hub's text, then its partners' texts."""
    names = ["a", "b", "shared", "na", "nb"]

    def run(batches):
        hub, hub_set = None, None
        for b in (whole.slice(lo, 128) for whole in batches for lo in range(0, whole.num_rows, 128)):
            out = []
            a, other, kind = (b.column(c).to_numpy() for c in ("a", "b", "kind"))
            for i, s in _sets(_unzipped(b.column("zipped")), k):
                if as_long(np.array([_class_of(s)]))[0] != other[i]:
                    continue  # another text with the same id
                if kind[i] == 0:
                    hub, hub_set = a[i], s
                elif hub == a[i]:
                    shared = len(np.intersect1d(hub_set, s, assume_unique=True))
                    out.append((a[i], other[i], shared, len(hub_set), len(s)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], pa.int64())
                                                  for j in range(5)], names=names)

    return run


def _tile_pairs(num, den, nearest=False):
    """Rows sorted by (key, block pair, n, cls): pairs of one tile that pass
    the size band and the bitmap bound; with ``nearest`` of these each row's
    pair with the largest bound only."""

    def pairs(t):
        key, n, cls, comp, tier, side = (t[c] for c in ("tile", "n", "cls", "comp", "tier", "side"))
        bits, rows, out = t["bits"], np.arange(len(key)), []
        best, partner = np.zeros(len(key)), np.full(len(key), -1)
        d = 1
        at = rows[:-1]
        while len(at):
            at = at[at + d < len(key)]
            nxt = at + d
            # Sorted by size: once the partner is too large for a row, all later ones are.
            near = (key[at] == key[nxt]) & (n[at] * den >= n[nxt] * num)
            at, nxt = at[near], nxt[near]
            # side 0 meets side 0 in a whole tile; in a tile of two blocks 1 meets 2.
            ok = (comp[at] != comp[nxt]) & (tier[at] + tier[nxt] > 0) & \
                (side[at] + side[nxt] != 2) & (side[at] + side[nxt] != 4)
            i, j = at[ok], nxt[ok]
            for lo in range(0, len(i), 65536):
                x, y = i[lo:lo + 65536], j[lo:lo + 65536]
                diff = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
                most = (n[x] + n[y] - diff) // 2
                good = most * (num + den) >= num * (n[x] + n[y])
                if nearest:
                    x, y, share = x[good], y[good], (most / (n[x] + n[y]))[good]
                    for a, b in ((x, y), (y, x)):  # at one distance d a row comes once on each side
                        new = share > best[a]
                        best[a[new]], partner[a[new]] = share[new], b[new]
                    continue
                out.append(np.stack([np.minimum(cls[x], cls[y]), np.maximum(cls[x], cls[y]),
                                     np.maximum(1, n[x] // SHARED)])[:, good])  # x is the smaller
            d += 1
        if nearest:
            x = np.flatnonzero(partner >= 0)
            y = partner[x]
            out = [np.stack([np.minimum(cls[x], cls[y]), np.maximum(cls[x], cls[y]), np.ones(len(x), np.int64)])]
        return np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)

    def run(batches):
        held = None
        for b in batches:
            t = {c: b.column(c).to_numpy() for c in ("tile", "n", "cls", "comp", "tier", "side")}
            t["bits"] = _bits_of(b.column("bits"))
            if held is not None:
                t = {c: np.concatenate([held[c], t[c]]) for c in t}
            last = int(np.searchsorted(t["tile"], t["tile"][-1])) if len(t["tile"]) else 0
            held = {c: v[last:] for c, v in t.items()}
            if last:
                p = pairs({c: v[:last] for c, v in t.items()})
                if p.shape[1]:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in p], names=["a", "b", "need"])
        if held is not None and len(held["tile"]):
            p = pairs(held)
            if p.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in p], names=["a", "b", "need"])

    return run


#: Bits of the filter that keeps most other texts out of the lookup's shuffle.
LOOKUP_BITS = 1 << 23


def _zipped(batches):
    """(id, compressed text), equal rows once a task."""
    seen = set()
    for b in (whole.slice(lo, 512) for whole in batches for lo in range(0, whole.num_rows, 512)):
        out = []
        for i, text in zip(b.column("id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
            z = len(text).to_bytes(8, "little") + pa.compress(text, codec="zstd", asbytes=True)
            mark = (i, hash(z))
            if mark not in seen:
                seen.add(mark)
                out.append((i, z))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()),
                                              pa.array([r[1] for r in out], pa.binary())], names=["id", "zipped"])


def _unzipped(col):
    return pa.array([pa.decompress(z[8:], decompressed_size=int.from_bytes(z[:8], "little"), codec="zstd",
                                   asbytes=True) for z in col.to_pylist()], pa.large_binary())


def _texts_for(docs: DataFrame, members: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` with ``zipped``, the text of a row of class ``b`` (also of
    other rows with that id: the reader checks the class).

    A bit table of ``LOOKUP_BITS`` (at most 131,072 rows, so safe to broadcast)
    drops most other rows before the exact join; it never drops a wanted one.
    """
    owner = members.where("n > 0").join(wanted.select(F.col("b").alias("cls")).distinct(), "cls", "left_semi") \
        .groupBy("cls").agg(F.coalesce(F.min("doc_id"), F.lit(0)).alias("id"))
    k, bit = F.pmod(F.xxhash64("id"), F.lit(LOOKUP_BITS)), F.expr("shiftleft(1L, cast(pmod(k, 64) as int))")
    table = owner.select(k.alias("k")).select((F.col("k") / 64).cast("int").alias("slot"), bit.alias("bit")) \
        .groupBy("slot").agg(F.expr("bit_or(bit)").alias("bits"))
    rows = docs.where("text is not null").select(F.coalesce("doc_id", F.lit(0)).alias("id"), "text") \
        .withColumn("k", k).withColumn("slot", (F.col("k") / 64).cast("int")).join(F.broadcast(table), "slot") \
        .where(F.col("bits").bitwiseAND(bit) != 0).select("id", "text").mapInArrow(_zipped, "id long, zipped binary")
    return wanted.join(owner.withColumnRenamed("cls", "b"), "b").join(rows, "id").drop("id")


#: Partners that meet their hub in one place; a hub with more has several.
SLICE = 256


def _settled(docs: DataFrame, members: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """Exact overlap of each candidate pair: (a, b, shared, na, nb). Pairs are
    dealt into slices while narrow; then each text travels once a slice."""
    crowded = pairs.groupBy("a").count().where(F.col("count") > SLICE) \
        .select(F.col("a").alias("c"), F.ceil(F.col("count") / SLICE).alias("slices"))
    dealt = written(pairs.join(crowded, F.col("a") == F.col("c"), "left").select(
        "a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.col("slices")), F.lit(0)).alias("slice")), "dealt")
    wanted = dealt.select("a", "slice", "b", F.lit(1).alias("kind")).unionByName(
        dealt.select("a", "slice", F.col("a").alias("b"), F.lit(0).alias("kind")).distinct())
    rows = _texts_for(docs, members, wanted).repartition("a", "slice") \
        .sortWithinPartitions("a", "slice", "kind", "b").select("a", "b", "kind", "zipped")
    return rows.mapInArrow(_settle(k), "a long, b long, shared long, na long, nb long")


def _across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose classes are not in one component yet."""
    x = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    y = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    return pairs.join(x, "a", "left").join(y, "b", "left") \
        .where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def _forest(pairs: DataFrame) -> DataFrame:
    """Each class with its smallest partner: enough to join most groups."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.groupBy("a").agg(F.min("b").alias("b")) \
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _tiles(rows: DataFrame) -> DataFrame:
    """Deal (key, n, cls, ...) into tiles of bounded size.

    A key with at most ``TILE`` rows is one tile. A larger one is cut by class
    hash into blocks; every two blocks meet in a tile (sides 1 and 2), and each
    block also meets itself (side 0).
    """
    big = rows.groupBy("key").count().where(F.col("count") > TILE) \
        .select(F.col("key").alias("bk"), F.ceil(F.col("count") / TILE).cast("int").alias("blocks"))
    dealt = rows.join(big, F.col("key") == F.col("bk"), "left")
    block = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    dealt = dealt.withColumn("block", F.coalesce(block, F.lit(0))).withColumn(
        "other", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0)))
                           .otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
    lo, hi = F.least("block", "other"), F.greatest("block", "other")
    return dealt.withColumn("tile", F.when(F.col("blocks").isNull(), F.col("key"))
                            .otherwise(F.xxhash64("key", lo, hi))) \
        .withColumn("side", F.when(F.col("block") == F.col("other"), 0)
                    .when(F.col("block") < F.col("other"), 1).otherwise(2))


def _dealt_tiles(rows: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """The tiles of ``rows``, sorted by size, with what their pairs are judged by."""
    about = classes.join(roots, F.col("cls") == F.col("node"), "left") \
        .select("cls", "n", "bits", F.coalesce("root", "cls").alias("comp"))
    return _tiles(rows).select("tile", "cls", "tier", "side").join(about, "cls") \
        .select("tile", "n", "cls", "comp", "tier", "side", "bits") \
        .repartition("tile").sortWithinPartitions("tile", "n", "cls")


def jaccard_groups(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Every row's shingle count and component: ``doc_id, n_shingles,
    component_id`` plus ``cls``, the class of equal sets (null when empty),
    ``root``, the class that stands for the component, and ``text_key``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark = docs.sparkSession
    described = written(docs.withColumn("text_key", _text_key()).mapInArrow(
        _describe(k), "row long, doc_id long, text_key long, cls long, n long, bits binary, wide binary, cells binary"),
        "sets")
    crowd = spark.sparkContext.broadcast(_crowding(described))
    members = described.where("row is null").select("doc_id", "text_key", "cls", "n")
    classes = written(described.where("n > 0").select("cls", "n", "bits", "wide").dropDuplicates(["cls"]), "classes")

    per_key = Window.partitionBy("key")
    keys = docs.where("text is not null").select("text") \
        .mapInArrow(_keys(k, num, den, crowd), "key long, cls long, n long")
    # The size band, on narrow rows: a class none of whose neighbours by size is
    # near enough has no partner under this key.
    by_size = per_key.orderBy("n", "cls")
    keys = keys.repartition("key").distinct().select(
        "key", "cls", "n", F.lag("n").over(by_size).alias("below"), F.lead("n").over(by_size).alias("above")) \
        .where((F.col("below") * den >= F.col("n") * num) | (F.col("n") * den >= F.col("above") * num))
    keys = written(keys.select("key", "cls", "n", F.count("*").over(per_key).alias("rows")), "keys")

    # Large tiles against their hub: partners linked to it (tier 0), within
    # twice the threshold distance (tier 1: may link to those), or further.
    large = keys.where(F.col("rows") >= STAR)
    hub = large.groupBy("key").agg(F.min("cls").alias("hub"))
    star = large.join(hub, "key").select("key", "hub", "cls")
    far_num = max(0, 2 * num - den)
    sides = star.where("hub <> cls").select(F.col("hub").alias("a"), F.col("cls").alias("b")).distinct()
    pairs = written(_bounded(sides, classes, far_num, den), "star")
    hub_links = _settled(docs, members, pairs, k).where(
        (den + far_num) * F.col("shared") >= far_num * (F.col("na") + F.col("nb")))
    hub_links = written(hub_links, "hublinks")
    is_link = (den + num) * F.col("shared") >= num * (F.col("na") + F.col("nb"))
    first = hub_links.where(is_link).select("a", "b")
    comps = written(components(first), "first")

    tier = F.when(F.col("hub") == F.col("cls"), 0).when(F.col("tier").isNull(), 2).otherwise(F.col("tier"))
    tiers = hub_links.select(F.col("a").alias("hub"), F.col("b").alias("cls"),
                             F.when(is_link, 0).otherwise(1).alias("tier"))
    large = star.join(tiers, ["hub", "cls"], "left").select("key", "cls", tier.alias("tier"))
    # The hub and what links to it are one component: where no class of a tile
    # lies between once and twice the distance, they need no more comparisons.
    between = large.where("tier = 1").select("key").distinct().withColumn("between", F.lit(True))
    large = large.join(between, "key", "left").where("tier > 0 or between").select("key", "cls", "tier")
    rows = written(keys.join(large, ["key", "cls"], "left")
                   .where((F.col("rows") < STAR) | F.col("tier").isNotNull())
                   .select("key", "cls", F.coalesce("tier", F.lit(2)).alias("tier"),
                           F.col("tier").isNotNull().alias("crowded")), "rows")
    links, roots = first, comps
    for _ in range(NEAREST):
        named = _dealt_tiles(rows.where("crowded"), classes, roots) \
            .mapInArrow(_tile_pairs(num, den, nearest=True), "a long, b long, need long") \
            .groupBy("a", "b").agg(F.count("*").alias("met"))
        named = named.unionByName(named.select(F.col("b").alias("a"), F.col("a").alias("b"), "met")).groupBy("a") \
            .agg(F.max_by("b", F.struct("met", "b")).alias("b")) \
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        named = written(_bounded(named, classes, num, den), "nearest")
        if named.isEmpty():
            break
        more = written(_settled(docs, members, named, k).where(is_link).select("a", "b"), "links")
        links = links.unionByName(more)
        roots = written(components(links), "roots")
    rest = _dealt_tiles(rows, classes, roots).mapInArrow(_tile_pairs(num, den), "a long, b long, need long") \
        .groupBy("a", "b", "need").agg(F.count("*").alias("met")).where("met >= need").select("a", "b")
    rest = written(_bounded(rest, classes, num, den), "candidates")
    # Pairs inside a component say nothing new. Two rounds settle one pair a
    # class, which joins most groups; the last settles all that is left.
    for last in (False, False, True):
        if rest.isEmpty():
            break
        now = rest if last else written(_forest(rest), "forest")
        more = written(_settled(docs, members, now, k).where(is_link).select("a", "b"), "links")
        links = links.unionByName(more)
        roots = written(components(links), "roots")
        if not last:
            rest = written(_across(rest.join(now, ["a", "b"], "left_anti"), roots), "rest")

    placed = members.join(roots, members["cls"] == roots["node"], "left") \
        .withColumn("root", F.coalesce("root", "cls"))
    placed = placed.select("doc_id", "text_key", "cls", F.col("n").alias("n_shingles"), "root")
    least = placed.groupBy("root").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    return met(placed, least, "root").withColumn("n", F.col("n_shingles")).select(
        "doc_id", "n_shingles",
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("cls")).alias("cls"),
        F.when(F.col("n") > 0, F.col("root")).alias("root"), "text_key")


def _text_key():
    """With the id, what tells rows apart."""
    return F.xxhash64(F.col("doc_id").isNull(), F.col("text"))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer name that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def _within(num, den):
    def run(batches):
        for b in batches:
            na, nb = b.column("na").to_numpy(), b.column("nb").to_numpy()
            keep = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column("wa"), b.column("wb"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                n = min(len(x), len(y))
                diff = int(np.bitwise_count(_folded(x, n) ^ _folded(y, n)).sum())
                keep[i] = (na[i] + nb[i] - diff) // 2 * (num + den) >= num * (na[i] + nb[i])
            yield b.select(["a", "b"]).filter(pa.array(keep))

    return run


def _bounded(sides: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs whose sizes and whole bitmaps allow a similarity of ``num / den``."""
    x = classes.select(F.col("cls").alias("a"), F.col("n").alias("na"))
    y = classes.select(F.col("cls").alias("b"), F.col("n").alias("nb"))
    both = sides.join(x, "a").join(y, "b").where(F.least("na", "nb") * den >= F.greatest("na", "nb") * num)
    both = both.join(classes.select(F.col("cls").alias("a"), F.col("wide").alias("wa")), "a") \
        .join(classes.select(F.col("cls").alias("b"), F.col("wide").alias("wb")), "b")
    return both.select("a", "b", "na", "nb", "wa", "wb").mapInArrow(_within(num, den), "a long, b long")


def jaccard_join(docs: DataFrame) -> DataFrame:
    """3-word shingles, similarity 0.9: ``doc_id, n_shingles, component_id``."""
    return jaccard_groups(docs, k=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` that stay when one row of each component is kept:
    that with the smallest id (a null id comes last), then the smallest text
    hash; of equal rows one. Rows without words have no component and all stay."""
    groups = written(jaccard_groups(docs, k, num, den).where("n_shingles > 0")
                     .select(F.coalesce("doc_id", F.lit(0)).alias("id"), "text_key", "root",
                             F.struct(F.col("doc_id").isNull(), "doc_id", "text_key").alias("rank")), "groups")
    best = groups.groupBy("root").agg(F.min("rank").alias("best"), F.count("*").alias("n"))
    i, key, fate, nth = (fresh(docs, c) for c in ("keep_id", "keep_key", "keep_fate", "keep_nth"))
    fates = met(groups, best, "root").groupBy("id", "text_key") \
        .agg(F.max(F.when(F.col("rank") == F.col("best"), 1).otherwise(0)).alias("f"), F.count("*").alias("copies")) \
        .where("f = 0 or copies > 1").select(F.col("id").alias(i), F.col("text_key").alias(key), F.col("f").alias(fate))
    rows = docs.withColumn(i, F.coalesce(F.col("doc_id").cast("long"), F.lit(0))) \
        .withColumn(key, F.xxhash64(F.col("doc_id").isNull(), F.col("text")))
    rows = rows.join(fates, [i, key], "left").where(f"`{fate}` is null or `{fate}` = 1")
    rows = rows.withColumn(nth, F.when(F.col(fate) == 1, F.row_number().over(
        Window.partitionBy(i, key).orderBy(fate))).otherwise(1))
    return rows.where(F.col(nth) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


ship_by_value(__name__)
