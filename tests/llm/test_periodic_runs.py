"""Runs by recompression against every stretch of every period."""

import hashlib
import zlib

import numpy as np
import pytest

from ratecraft.llm import periodic_runs as pr


def brute(words, least=pr.LEAST):
    """(start, length, period): for each period, the maximal stretches in which
    words that far apart agree; of one stretch the smallest period."""
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                best.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, size, q) for (s, size), q in best.items())


def brute_row(doc_id, text, plant):
    words = (text or "").encode().split()
    h, n = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()), len(words)
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    longest = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    best = (None,) * 4 if longest is None else (*longest, 1000 * longest[1] // longest[2])
    return (doc_id, len(found), *best, hashlib.sha256("".join("%d,%d,%d\n" % r for r in found).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())


def _texts():
    rng = np.random.default_rng(11)
    out = [[], ["a"], ["a"] * 400, ["a", "b"] * 90 + ["c"] + ["a", "b"] * 70, ["a"] * 11, ["a"] * 12]
    for letters in (1, 2, 2, 3, 4, 30):
        for n in (5, 13, 60, 250):
            out.append([f"w{k}" for k in rng.integers(0, letters, n)])
    for p in (1, 2, 5, 6, 7, 40):  # periods inside other words, with a flaw
        core = [f"x{k}" for k in rng.integers(0, 9, p)] * 9
        out.append(["y1", "y2"] + core + ["y3"] + core[1:] + core[:p // 2] + ["y4"])
    a, b = ["f"], ["f", "g"]  # a text with a run at every scale
    while len(b) < 600:
        a, b = b, b + a
    return [*out, b]


def test_runs_and_extensions_match_brute_force():
    texts = _texts()
    sym, base, n = pr._numbered(texts)
    start, end, q = pr.runs(sym, base, n)
    got = {k: [] for k in range(len(texts))}
    for s, e, p in zip(start.tolist(), end.tolist(), q.tolist(), strict=True):
        k = int(np.searchsorted(base, s, side="right")) - 1
        while n[k] == 0 or s >= base[k] + n[k]:
            k += 1
        got[k].append((s - int(base[k]), e - s, p))
    for k, words in enumerate(texts):
        assert sorted(got[k]) == brute(words), k
    levels = pr.recompress(sym)
    rng = np.random.default_rng(5)
    x = rng.integers(1, len(sym) - 1, 4000)
    y = rng.integers(1, len(sym) - 1, 4000)
    x, y = x[x != y], y[x != y]
    for back in (False, True):
        got = pr.extension(levels, x, y, back)
        for a, b, size in zip(x.tolist(), y.tolist(), got.tolist(), strict=True):
            k = 0
            while sym[a] == sym[b]:
                a, b, k = (a - 1, b - 1, k + 1) if back else (a + 1, b + 1, k + 1)
            assert k == size


def test_levels_shrink_to_one_symbol_a_text():
    sym, base, n = pr._numbered([[str(k) for k in range(3000)], ["a"] * 5000])
    levels = pr.recompress(sym)
    assert len(levels[-1].sym) == 5 and len(levels) < 90


def test_grid_pieces_cover_all_pairs(monkeypatch):
    base, n = np.array([1, 40, 41, 60]), np.array([30, 0, 1, 17])
    whole = {(i, q) for a, b in pr._grid(base, n) for i, q in zip(a.tolist(), b.tolist(), strict=True)}
    want = {(b + i, q) for b, m in zip(base.tolist(), n.tolist(), strict=True)
            for q in range(1, m // 2 + 1) for i in range(0, m - q, q)}
    assert whole == want
    monkeypatch.setattr(pr, "PAIRS", 7)
    assert {(i, q) for a, b in pr._grid(base, n) for i, q in zip(a.tolist(), b.tolist(), strict=True)} == want


@pytest.mark.parametrize("plant", [False, True])
def test_report_matches_brute_force(docs, plant):
    rows = [(i, " ".join(w)) for i, w in enumerate(_texts())]
    rows += [(None, "a b c d e f g h"), (900, None), (901, ""), (902, " \t\n"), (902, " \t\n"),
             (903, "é x y é z \x0b é x y é z \x0c" * 5), (904, "ja " * 30_000), (20, "n o p " * 40)]
    got = pr.run_report(docs(rows), plant).collect()
    key = lambda r: tuple((v is not None, v) for v in r)
    small = [r for r in rows if r[0] != 904]
    assert sorted((tuple(r) for r in got if r.doc_id != 904), key=key) == sorted(
        (brute_row(i, t, plant) for i, t in small), key=key)
    long = next(r for r in got if r.doc_id == 904)
    if not plant or zlib.crc32(b"904") % 10:
        assert (long.n_runs, long.start, long.length, long.period, long.exponent_milli) == (1, 0, 30_000, 1, 30_000_000)


def test_empty_table(docs):
    assert pr.run_report(docs([(1, "a")]).where("doc_id = 2")).collect() == []
