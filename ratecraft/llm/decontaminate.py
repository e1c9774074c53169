"""Benchmark decontamination by greedy string tiling.

A document is contaminated by a benchmark item if tiles of at least ``LEAST``
words cover at least ``COVER`` percent of the item's words. Tiles are the
longest matches between the two word sequences, marked longest first, never
overlapping in either; their order is free, so reordered passages count.

1. Tasks turn each item into its words' hashes and its seeds, all runs of
   ``LEAST`` words. A bit table of the seeds, of fixed size, goes to every task.
2. Tasks turn each document into its distinct seeds and send those whose bit is
   set, each text once. They are joined with the items' seeds. Tiles that cover
   ``c`` words hold at least ``c / LEAST`` seeds, so pairs of a text and an item
   that share fewer are done: the count bounds every tiling from above.
3. The texts of the pairs that are left meet their items, ``BLOCK_WORDS`` words
   of items in one place, and are tiled: Karp-Rabin fingerprints of falling
   window lengths find matches between unmarked words.

Words are runs of letters, digits and non-ASCII characters, in lower case, so
punctuation and case don't hide a passage. A task holds one slice of texts, or
one text and one item; nothing but the bit table passes through the driver.

Defined results: null and empty texts, and items without words, are never
contaminated and never match; an item of fewer than ``LEAST`` words matches
where all its words stand in a row; a document that holds several items gives a
row for each; repeated documents repeat, equal items count once; null ids are
carried. Word, text and item identity rests on 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratecraft.llm.common import (
    PLAIN,
    as_long,
    fold_case,
    hash_shingles,
    hash_words,
    ship_by_value,
    text_slices,
    written,
)
from ratecraft.llm.jaccard import fresh

#: Words of the shortest tile, and of a seed.
LEAST = 5
#: Percent of an item's words that tiles must cover.
COVER = 80
#: Words of items that meet one text in one place; a text with more has several.
BLOCK_WORDS = 1 << 20
#: Bits of the table of item seeds (at most 131,072 rows of 64).
SIEVE_BITS = 1 << 23
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _tokens(col):
    for lo, _, data, off in text_slices(col):
        yield lo, *hash_words(fold_case(data), off, lower=False, cut=PLAIN)[::2]


def fingerprints(h: np.ndarray, s: int) -> np.ndarray:
    """Karp-Rabin fingerprints of all windows of ``s`` words, mod 2**64: window
    sums of a polynomial, doubled in length until they span ``s``."""
    n = len(h) - s + 1
    out, length, done, at = np.zeros(n, np.uint64), 1, 0, h
    factor = int(_BASE)
    while s >> done:
        if (s >> done) & 1:
            off = s & ((1 << done) - 1)  # the lower bits' words come first
            out = out + at[off:off + n] * np.uint64(pow(int(_BASE), off, 1 << 64))
        if s >> (done + 1):
            at = at[:len(at) - length] + at[length:] * np.uint64(factor)
            factor = factor * factor % (1 << 64)
        length *= 2
        done += 1
    return out


def _matches(p, t, mark_p, mark_t, s):
    """Maximal matches of at least ``s`` unmarked words: rows (length, i, j)."""
    if len(p) < s or len(t) < s:
        return np.zeros((0, 3), np.int64)

    def free(mark):
        c = np.concatenate([[0], np.cumsum(mark)])
        return np.flatnonzero(c[s:] == c[:-s])

    ip, jt = free(mark_p), free(mark_t)
    if not len(ip) or not len(jt):
        return np.zeros((0, 3), np.int64)
    fp, ft = fingerprints(p, s)[ip], fingerprints(t, s)[jt]
    order = np.argsort(fp, kind="stable")
    fp, ip = fp[order], ip[order]
    lo, hi = np.searchsorted(fp, ft, "left"), np.searchsorted(fp, ft, "right")
    count = hi - lo
    if not count.any():
        return np.zeros((0, 3), np.int64)
    j = np.repeat(jt, count)
    i = ip[np.repeat(lo, count) + np.arange(len(j)) - np.repeat(np.cumsum(count) - count, count)]
    order = np.lexsort((i, j - i))
    i, j = i[order], j[order]
    new = np.concatenate([[True], (np.diff(i) != 1) | (np.diff(j) != 1)])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(i)))
    return np.stack([runs + s - 1, i[at], j[at]], axis=1)


def tiling(p: np.ndarray, t: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two sequences: tiles (start in p, start in t,
    length), longest first; ties by place in p, then in t."""
    mark_p, mark_t, tiles = np.zeros(len(p), bool), np.zeros(len(t), bool), []
    s = max(least, min(len(p), len(t)) // 2)
    while True:
        found = _matches(p, t, mark_p, mark_t, s)
        if len(found):
            found = found[np.lexsort((found[:, 2], found[:, 1], -found[:, 0]))]
            longest = found[0, 0]
            marked = 0
            # Only the longest are certain: marking one may cut those that are left.
            for n, i, j in found[found[:, 0] == longest]:
                if not mark_p[i:i + n].any() and not mark_t[j:j + n].any():
                    mark_p[i:i + n] = mark_t[j:j + n] = True
                    tiles.append((int(i), int(j), int(n)))
                    marked += 1
            if marked:
                continue
        if s == least:
            return tiles
        s = max(least, s // 2)


def _item_seeds(batches):
    """Items with words: their number, hashes and seeds; a short item is one seed."""
    for b in batches:
        for lo, h, woff in _tokens(b.column("text")):
            seeds, soff = hash_shingles(h, woff, LEAST)
            at = np.flatnonzero(np.diff(woff))
            yield pa.RecordBatch.from_arrays(
                [b.column("ik").take(pa.array(lo + at)), b.column("item_id").take(pa.array(lo + at)),
                 pa.array(np.diff(woff)[at]),
                 pa.array([h[woff[i]:woff[i + 1]].tobytes() for i in at], pa.binary()),
                 pa.array([as_long(seeds[soff[i]:soff[i + 1]]) for i in at], pa.list_(pa.int64()))],
                names=["ik", "item_id", "n", "words", "seeds"])


def _text_seeds(h, woff, widths):
    """Seeds of each text: (hashes, the text of each) for items of these widths."""
    found = [hash_shingles(h, woff, k) for k in widths]
    seeds = np.concatenate([s for s, _ in found]) if found else np.zeros(0, np.uint64)
    of = [np.repeat(np.arange(len(soff) - 1), np.diff(soff)) for _, soff in found]
    return seeds, np.concatenate(of) if of else np.zeros(0, np.int64)


def _sieved(sieve, widths):
    """Texts with a seed whose bit is set: their distinct seeds of that kind."""
    def run(batches):
        bits = np.frombuffer(sieve.value, np.uint64)
        for b in batches:
            ids, t = b.column("doc_id"), b.column("t")
            for lo, h, woff in _tokens(b.column("text")):
                seeds, of = _text_seeds(h, woff, widths)
                slot = (seeds & np.uint64(SIEVE_BITS - 1)).astype(np.int64)
                hit = (bits[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1
                seeds, of = seeds[hit], of[hit]
                order = np.argsort(of, kind="stable")
                seeds, of = seeds[order], of[order]
                docs, first = np.unique(of, return_index=True)
                if len(docs):
                    rows = pa.array(lo + docs)
                    parts = [as_long(np.unique(x)) for x in np.split(seeds, first[1:])]
                    yield pa.RecordBatch.from_arrays([ids.take(rows), t.take(rows), pa.array(parts, pa.list_(pa.int64()))],
                                                     names=["doc_id", "t", "seeds"])

    return run


def _spans(p, seeds):
    """Words of ``p`` that lie in a run whose seed is among the sorted ``seeds``."""
    k = min(LEAST, len(p))
    own = hash_shingles(p, np.array([0, len(p)]), k)[0]
    places = np.flatnonzero(np.isin(own, seeds))
    edge = np.zeros(len(p) + 1, np.int64)
    edge[places] += 1
    edge[places + k] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum())


def _tile(cover):
    """Rows by text and slice: the text (kind 0), then its items (kind 1)."""
    names = ["t", "item_id", "item_words", "covered_words", "n_tiles", "longest_tile", "tiles"]
    kinds = [pa.int64()] * 6 + [pa.list_(pa.list_(pa.int64()))]

    def run(batches):
        words, seeds = None, {}
        for b in batches:
            out = []
            for t, kind, item, payload in zip(*[b.column(c) for c in ("t", "kind", "item_id", "payload")], strict=True):
                if not kind.as_py():
                    for _, words, _ in _tokens(pa.array([payload.as_buffer().to_pybytes()], pa.binary())):
                        seeds = {}
                    continue
                p = np.frombuffer(payload.as_buffer(), np.uint64)
                k = min(LEAST, len(p))
                if k not in seeds:
                    seeds[k] = np.unique(hash_shingles(words, np.array([0, len(words)]), k)[0])
                if 100 * _spans(p, seeds[k]) < cover * len(p):
                    continue
                tiles = tiling(p, words, k)
                covered = sum(x[2] for x in tiles)
                if 100 * covered >= cover * len(p):
                    out.append((t.as_py(), item.as_py(), len(p), covered, len(tiles), max(x[2] for x in tiles),
                                [list(x) for x in tiles]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], k) for j, k in enumerate(kinds)],
                                                 names=names)

    return run


def _text_id(text="text"):
    return F.xxhash64(F.col(text))


def _seeded(items: DataFrame):
    """What tasks need to tell seeds: the bits, and the widths of items."""
    slot = F.expr(f"cast(shiftright(seed & {SIEVE_BITS - 1}, 6) as int)")
    bit = F.expr("shiftleft(1L, cast(seed & 63 as int))")
    table = items.select(F.explode("seeds").alias("seed")).groupBy(slot.alias("slot")).agg(F.bit_or(bit).alias("bits"))
    bits = np.zeros(SIEVE_BITS // 64, np.uint64)
    for r in table.collect():  # at most SIEVE_BITS / 64 rows
        bits[r.slot] = r.bits & 0xFFFFFFFFFFFFFFFF
    widths = items.select(F.least("n", F.lit(LEAST)).alias("n")).distinct().collect()  # at most LEAST rows
    return bits.tobytes(), sorted(r.n for r in widths)


def _tiled(docs: DataFrame, benchmark: DataFrame, cover: int):
    """(hits, found): ``hits(doc_id, t, seeds)`` of documents that may match, and
    the tiles of each contaminated text ``t`` and item."""
    sc = docs.sparkSession.sparkContext
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text") \
        .withColumn("ik", F.xxhash64("item_id", "text")).dropDuplicates(["ik"])
    items = written(items.mapInArrow(_item_seeds, "ik long, item_id long, n long, words binary, seeds array<bigint>"),
                    "items")
    sieve, widths = _seeded(items)
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text") \
        .withColumn("t", _text_id())
    hits = written(texts.mapInArrow(_sieved(sc.broadcast(sieve), widths), "doc_id long, t long, seeds array<bigint>"),
                   "hits")

    # Words to cover, and the seeds that tiles over so many words hold at least.
    need = F.when(F.col("n") < LEAST, F.lit(1)).otherwise(F.ceil(F.ceil(F.col("n") * cover / 100) / LEAST))
    seeds = items.select("ik", "n", need.alias("need"), F.explode("seeds").alias("seed")) \
        .groupBy("ik", "n", "need", "seed").agg(F.count("*").alias("places"))
    # Plain shuffles on both sides, so that a seed of many texts can be split.
    seeds = written(seeds, "seeds")
    seen = written(hits.select("t", F.explode("seeds").alias("seed")).distinct(), "seen")
    pairs = written(seen.join(seeds, "seed").groupBy("t", "ik", "n", "need").agg(F.sum("places").alias("shared"))
                    .where("shared >= need").select("t", "ik", "n"), "pairs")

    wide = pairs.groupBy("t").agg(F.ceil(F.sum("n") / BLOCK_WORDS).alias("slices"))
    wanted = written(wide, "wanted")
    dealt = written(pairs.join(wanted, "t").select("t", "ik", F.pmod(F.xxhash64("ik"), F.col("slices")).alias("slice")),
                    "dealt")
    copies = texts.select("t", "text").join(wanted, "t", "left_semi").dropDuplicates(["t"]) \
        .join(dealt.select("t", "slice").distinct(), "t")
    met = copies.select("t", "slice", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("item_id"),
                        F.col("text").cast("binary").alias("payload")) \
        .unionByName(dealt.join(items, "ik").select("t", "slice", F.lit(1).alias("kind"), "item_id",
                                                    F.col("words").alias("payload")))
    met = met.repartition("t", "slice").sortWithinPartitions("t", "slice", "kind", "item_id")
    found = met.mapInArrow(_tile(cover), "t long, item_id long, item_words long, covered_words long, n_tiles long,"
                           " longest_tile long, tiles array<array<bigint>>")
    return hits, written(found, "tiles")


def contaminated(docs: DataFrame, benchmark: DataFrame, cover: int = COVER) -> DataFrame:
    """(doc_id, item_id, item_words, covered_words, n_tiles, longest_tile,
    tiles) of each document and item whose tiles cover enough; a tile is
    [word in the item, word in the document, words]."""
    hits, found = _tiled(docs, benchmark, cover)
    return hits.select("doc_id", "t").join(found, "t").drop("t")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, cover: int = COVER) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, all columns unchanged.
    Decided by the text, so rows that share an id stay apart."""
    _, found = _tiled(docs, benchmark, cover)
    t = fresh(docs, "text_id")
    # Rows without a text have no key: they match nothing and stay. The texts are
    # written, so that a key that many rows share can be split.
    key = F.when(F.col("text").isNotNull(), _text_id())
    texts = written(found.select(F.col("t").alias(t)).distinct(), "contaminated")
    return docs.withColumn(t, key).join(texts, t, "left_anti") \
        .select(*[F.col(f"`{c}`") for c in docs.columns])


ship_by_value(__name__)
