"""The k-th smallest of a distributed column, by refining a histogram.

Keys are hex strings of one length (md5). Each pass counts the keys that begin
with the prefixes still open by their next ``DIGITS`` digits (at most
``16 ** DIGITS`` counts a wanted rank reach the driver, whatever the data), and
narrows each rank to one longer prefix; a prefix with few keys is read out.
Three passes do for 10^12 different keys; keys of equal value are counted, never
sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

DIGITS = 4
#: Keys that are read out at most, instead of counted once more.
FEW = 4096


def _prefix(d: int):
    return F.substring("key", 1, d)


def kth_smallest(keys: DataFrame, ranks: list[int]) -> list[tuple[str, int, int]]:
    """For each 1-based rank of ``keys(key)``: (its key, smaller keys, equal keys)."""
    at = {r: ("", 0) for r in ranks}           # open prefix, keys below it
    done: dict = {}
    depth = 0
    while len(done) < len(at):
        todo = sorted({at[r][0] for r in at if r not in done})
        rows = keys if not depth else keys.where(_prefix(depth).isin(todo))
        bins: dict = {p: [] for p in todo}
        for r in rows.groupBy(_prefix(depth + DIGITS).alias("p")).count().collect():
            bins[r["p"][:depth]].append((r["p"], r["count"]))
        for r in [r for r in at if r not in done]:
            prefix, below = at[r]
            for p, n in sorted(bins[prefix]):
                if below + n >= r:
                    break
                below += n
            else:
                raise ValueError(f"there is no key of rank {r}")
            at[r] = p, below
            if n <= FEW:
                for key, m in sorted((x["key"], x["count"]) for x in keys.where(
                        F.col("key").startswith(p)).groupBy("key").count().collect()):
                    if below + m >= r:
                        done[r] = key, below, m
                        break
                    below += m
        depth += DIGITS
        if depth >= 32:
            for r in [r for r in at if r not in done]:  # many equal keys: the prefix is the key
                p, below = at[r]
                done[r] = p, below, dict(bins[p[:depth - DIGITS]])[p]
    return [done[r] for r in ranks]
