"""Periodic runs of words, by recompression.

A run is a stretch of consecutive words with smallest period q (words q apart
are identical) and a length of at least ``max(LEAST, 2 q)`` that neither
neighbouring word extends.

Method. The texts of a slice become one sequence of word numbers, each text
closed by a symbol of its own. Recompression shortens it in turn by blocks
(maximal repeats of one symbol become one symbol) and by pairs (symbols are
dealt to a left and a right side by a hash; a left one followed by a right one
becomes one symbol), until every text is a single symbol. Equal stretches are
cut alike at every level but for their ends, so the longest common extension of
two positions climbs the levels while both stand at a cut, and descends from
the first difference: some steps a level, for all queries at once. Any run of
period q and length 2 q or more holds two neighbours of the grid 0, q, 2 q, ...;
these n ln n pairs are the candidates, and those with equal words are extended
forward and backward to the run's exact ends. A stretch found under several
periods keeps the smallest (the others are its multiples).

Words are numbered exactly (a dictionary), so nothing rests on hash odds; the
hash only decides the cuts, which decide the speed. A slice holds about 1 MB of
texts or one longer text; its levels take some 100 bytes a word, candidates are
made at most ``PAIRS`` (or the words of one text) at a time. No shuffle.

Defined results: null and empty texts have no words and no runs (four nulls,
hashes of the empty string); a null id counts as the empty string in the crc32;
repeated rows are judged one by one; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ratecraft.llm.common import mix64, ship_by_value, text_slices

#: Least length of a run.
LEAST = 12
#: Candidate pairs handled at once.
PAIRS = 1 << 20


class Level:
    """Symbols of one level, and how they are merged into the next.

    ``first[i]``: symbol i starts a symbol of the next level; ``up[i]``: which;
    ``edge``: the first symbol of each, and the end; ``block``: merged by equal
    symbols.
    """

    __slots__ = ("block", "edge", "first", "sym", "up")

    def __init__(self, sym, first=None, block=False):
        self.sym, self.first, self.block = sym, first, block
        if first is not None:
            self.edge = np.append(np.flatnonzero(first), len(sym)).astype(np.int32)
            self.up = (np.cumsum(first, dtype=np.int32) - 1).astype(np.int32)


def recompress(sym: np.ndarray) -> list[Level]:
    """Levels of the run-length grammar of ``sym``, the last without a merge.

    Negative symbols close texts: each is unique, and never merged. The first
    and last symbol must be negative.
    """
    sym = sym.astype(np.int32)
    levels, fresh, depth = [], int(sym.max(initial=0)) + 1, 0
    while True:
        plain = sym >= 0
        joint = plain[1:] & plain[:-1]
        if not joint.any():
            levels.append(Level(sym))
            return levels
        block = depth % 2 == 0
        if block:
            merge = joint & (sym[1:] == sym[:-1])
        else:
            right = (mix64(sym.astype(np.int64).view(np.uint64) + np.uint64(depth << 32)) & np.uint64(1)).astype(bool)
            merge = joint & ~right[:-1] & right[1:]
        depth += 1
        if not merge.any():
            continue
        first = np.ones(len(sym), bool)
        first[1:] = ~merge
        levels.append(Level(sym, first, block))
        at, size = levels[-1].edge[:-1], np.diff(levels[-1].edge)
        grown = np.flatnonzero(size > 1)
        head = sym[at[grown]].astype(np.int64)
        tail = size[grown] if block else sym[at[grown] + 1]
        names, which = np.unique((head << 32) | tail.astype(np.int64), return_inverse=True)
        sym = sym[at]
        sym[grown] = fresh + which
        fresh += len(names)


def _left(level: Level, x, back: bool):
    """Symbols of a block from ``x`` to its end (its start, if ``back``)."""
    if back:
        return x - level.edge[level.up[x]] + 1
    return level.edge[level.up[x] + 1] - x


def extension(levels: list[Level], x, y, back: bool = False) -> np.ndarray:
    """How many symbols agree from positions ``x`` and ``y`` on (or, with
    ``back``, from there toward the front), for arrays of positions."""
    x, y = x.astype(np.int64), y.astype(np.int64)
    x0, sign = x.copy(), -1 if back else 1
    stop = np.zeros(len(x), np.int32)
    active = np.arange(len(x))
    for t, level in enumerate(levels):
        top = level.first is None
        todo = active
        rising = []
        while len(todo):
            a, b = x[todo], y[todo]
            same = level.sym[a] == level.sym[b]
            stop[todo[~same]] = t
            todo, a, b = todo[same], a[same], b[same]
            if not len(todo):
                break
            if top:
                step = 1
            else:
                edge = (level.first[a + 1] & level.first[b + 1]) if back else (level.first[a] & level.first[b])
                rising.append(todo[edge])
                todo, a, b = todo[~edge], a[~edge], b[~edge]
                step = np.minimum(_left(level, a, back), _left(level, b, back)) if level.block else 1
            x[todo] = a + sign * step
            y[todo] = b + sign * step
        if top:
            break
        active = np.concatenate(rising) if rising else active[:0]
        if not len(active):
            break
        x[active], y[active] = level.up[x[active]], level.up[y[active]]
    order = np.argsort(-stop, kind="stable")
    deep = stop[order]
    for t in range(int(deep[0]) - 1 if len(deep) else -1, -1, -1):
        level = levels[t]
        todo = order[:np.searchsorted(-deep, -t, side="left")]
        if back:
            x[todo], y[todo] = level.edge[x[todo] + 1] - 1, level.edge[y[todo] + 1] - 1
        else:
            x[todo], y[todo] = level.edge[x[todo]], level.edge[y[todo]]
        while len(todo):
            a, b = x[todo], y[todo]
            same = level.sym[a] == level.sym[b]
            todo, a, b = todo[same], a[same], b[same]
            step = np.minimum(_left(level, a, back), _left(level, b, back)) if level.block else 1
            x[todo] = a + sign * step
            y[todo] = b + sign * step
    return np.abs(x - x0)


def _grid(base, n):
    """(position, period) of every grid pair of texts that begin at ``base``
    and have ``n`` symbols, about ``PAIRS`` at a time."""
    half = n // 2
    text = np.repeat(np.arange(len(n)), half)
    q = np.arange(int(half.sum()), dtype=np.int64) - np.repeat(np.cumsum(half) - half, half) + 1
    count = (n[text] - 1) // q
    upto = np.cumsum(count)
    lo = 0
    while lo < len(q):
        hi = int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS, side="right"))
        hi = max(hi, lo + 1)
        size = count[lo:hi]
        period = np.repeat(q[lo:hi], size)
        k = np.arange(len(period)) - np.repeat(np.cumsum(size) - size, size)
        yield np.repeat(base[text[lo:hi]], size) + k * period, period
        lo = hi


def _smallest(start, end, q):
    """Each stretch once, with its smallest period, in order."""
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return start[new], end[new], q[new]


def runs(sym: np.ndarray, base: np.ndarray, n: np.ndarray, least: int = LEAST):
    """All runs (start, end, period) of the texts of ``sym``, by start."""
    levels = recompress(sym)
    found = [(np.zeros(0, np.int64),) * 3]
    for i, q in _grid(base, n):
        hit = sym[i] == sym[i + q]
        i, q = i[hit], q[hit]
        ahead, behind = extension(levels, i, i + q), extension(levels, i - 1, i + q - 1, back=True)
        ok = (ahead + behind >= q) & (ahead + behind + q >= least)
        found.append(_smallest((i - behind)[ok], (i + q + ahead)[ok], q[ok]))
    return _smallest(*(np.concatenate(x) for x in zip(*found, strict=True)))


def planted(words: list, doc_id: str) -> list:
    """The words with the periodic tail that the audit plants in one text in ten."""
    h, n = zlib.crc32(doc_id.encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a:a + p]
    return words[:a] + (tail * -(-(n - a) // p))[:n - a]


def _numbered(texts):
    """One sequence of word numbers with closing symbols, and where texts begin."""
    known: dict = {}
    n = np.array([len(w) for w in texts], np.int64)
    base = 1 + np.cumsum(n + 1) - (n + 1)
    sym = np.empty(int((n + 1).sum()) + 1, np.int32)
    sym[0] = -1
    for k, words in enumerate(texts):
        sym[base[k]:base[k] + n[k]] = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, n[k])
        sym[base[k] + n[k]] = -k - 2
    return sym, base, n


def _reports(texts, least):
    """Of each text: runs, the longest, and the hashes of runs and of what is left."""
    sym, base, n = _numbered(texts)
    start, end, q = runs(sym, base, n, least)
    drop = np.zeros(len(sym) + 1, np.int64)
    np.add.at(drop, start + q, 1)
    np.add.at(drop, end, -1)
    drop = np.cumsum(drop) > 0
    cut = np.searchsorted(start, np.append(base, len(sym)))
    for k, words in enumerate(texts):
        own = slice(cut[k], cut[k + 1])
        s, size, p = start[own] - base[k], (end - start)[own], q[own]
        listed = "".join(f"{a},{b},{c}\n" for a, b, c in zip(s.tolist(), size.tolist(), p.tolist(), strict=True))
        if len(s):
            best = int(np.argmax(size))  # the first of the longest has the smallest start
            longest = int(s[best]), int(size[best]), int(p[best]), int(1000 * size[best] // p[best])
            gone = drop[base[k]:base[k] + n[k]]
            words = [w for w, d in zip(words, gone.tolist(), strict=True) if not d]
        else:
            longest = None, None, None, None
        yield (len(s), *longest, hashlib.sha256(listed.encode()).hexdigest(),
               hashlib.sha256(b" ".join(words)).hexdigest())


_FIELDS = [("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()),
           ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]
_DDL = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _find(plant: bool, least: int):
    def run(batches):
        for b in batches:
            named = ["" if i is None else str(i) for i in b.column("doc_id").to_pylist()]
            for lo, hi, data, off in text_slices(b.column("text")):
                raw = data.tobytes()
                # bytes.split() cuts at space and \t \n \v \f \r, the separators of words.
                texts = [raw[a:z].split() for a, z in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                if plant:
                    texts = [planted(w, i) for w, i in zip(texts, named[lo:hi], strict=True)]
                rows = list(zip(*_reports(texts, least), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, hi - lo), *(pa.array(c, t) for c, (_, t) in zip(rows, _FIELDS, strict=True))],
                    names=["doc_id", *(name for name, _ in _FIELDS)])

    return run


def run_report(docs: DataFrame, plant: bool = False, least: int = LEAST) -> DataFrame:
    """Per document ``n_runs``, the longest run and the hashes of all runs and of
    the text without them; ``plant`` first plants periodic tails."""
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(_find(plant, least), f"doc_id {kind}, {_DDL}")


ship_by_value(__name__)
