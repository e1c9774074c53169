"""Tiling against brute force; reordered, altered and clean documents."""

import random
import re

import numpy as np
import pytest

from ratecraft.llm import decontaminate as dc


def brute(p, t, least):
    mp, mt, tiles = [0] * len(p), [0] * len(t), []
    while True:
        best, longest = [], least
        for i in range(len(p)):
            for j in range(len(t)):
                k = 0
                while i + k < len(p) and j + k < len(t) and p[i + k] == t[j + k] and not mp[i + k] and not mt[j + k]:
                    k += 1
                if k > longest:
                    best, longest = [(i, j, k)], k
                elif k == longest:
                    best.append((i, j, k))
        if not best:
            return tiles
        for i, j, k in best:
            if not any(mp[i:i + k]) and not any(mt[j:j + k]):
                for x in range(k):
                    mp[i + x] = mt[j + x] = 1
                tiles.append((i, j, k))


def test_tiling_matches_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        p = [rng.randrange(3) for _ in range(rng.randint(0, 14))]
        t = [rng.randrange(3) for _ in range(rng.randint(0, 18))]
        assert dc.tiling(np.array(p, np.uint64), np.array(t, np.uint64), 2) == brute(p, t, 2)


def test_fingerprints_tell_windows_apart():
    h = np.random.default_rng(1).integers(0, 4, 200).astype(np.uint64)
    for s in (1, 2, 3, 5, 7, 16):
        f = dc.fingerprints(h, s)
        seen = {}
        for i, x in enumerate(f.tolist()):
            assert seen.setdefault(tuple(h[i:i + s].tolist()), x) == x
        assert len(set(seen.values())) == len(seen)


@pytest.fixture
def case(spark, docs):
    item = [f"Q{i}" for i in range(40)]
    rng = random.Random(2)
    fill = lambda n: [f"z{rng.randrange(999)}" for _ in range(n)]
    rows = [
        (1, " ".join(fill(30) + item + fill(30))),
        (2, " ".join(fill(5) + item[20:] + fill(9) + item[:20])),            # reordered
        (3, ", ".join(w.lower() + "." for w in item)),                       # case and marks
        (4, " ".join(item[:25] + fill(40))),                                 # too little
        (5, " ".join(w for x in range(0, 40, 4) for w in [*item[x:x + 4], "zz"])),  # runs too short
        (6, " ".join(fill(400))), (7, None), (8, ""), (None, " ".join(item)), (1, "clean text"),
        (9, " ".join(item) + " x" * 20000), (10, " ".join(f"R{i}" for i in range(30)) + " " + " ".join(item)),
    ]
    benchmark = spark.createDataFrame(
        [(100, " ".join(item)), (101, " ".join(f"R{i}" for i in range(30))), (102, "a b"), (103, None), (104, "")],
        "item_id long, text string")
    return docs(rows), benchmark


@pytest.mark.parametrize("block", [dc.BLOCK_WORDS, 10])
def test_pairs(case, monkeypatch, block):
    monkeypatch.setattr(dc, "BLOCK_WORDS", block)  # 10: every item is a block
    d, benchmark = case
    got = dc.contaminated(d, benchmark).collect()
    assert sorted(((r.doc_id, r.item_id) for r in got), key=str) == sorted(
        [(1, 100), (2, 100), (3, 100), (None, 100), (9, 100), (10, 100), (10, 101)], key=str)
    two = next(r for r in got if r.doc_id == 2)
    assert two.n_tiles == 2 and two.covered_words == 40 and sorted(t[0] for t in two.tiles) == [0, 20]


def test_drop_keeps_clean_rows_whole(case):
    d, benchmark = case
    kept = dc.drop_contaminated(d, benchmark)
    assert kept.columns == d.columns
    assert sorted((r.doc_id for r in kept.collect())) == [1, 4, 5, 6, 7, 8]
    assert dc.drop_contaminated(d, benchmark.where("item_id < 0")).count() == d.count()
    assert dc.contaminated(d.where("doc_id = 99"), benchmark).collect() == []


def brute_pairs(docs, items, cover):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = set()
    for d, text in docs:
        for i, item in items:
            p, t = words(item), words(text)
            if p and t:
                tiles = brute(p, t, min(dc.LEAST, len(p)))
                covered = sum(x[2] for x in tiles)
                if 100 * covered >= cover * len(p):
                    out.add((d, i, len(p), covered, len(tiles), max(x[2] for x in tiles)))
    return out


@pytest.mark.parametrize("cover,block", [(80, dc.BLOCK_WORDS), (50, 10)])
def test_rows_match_brute_force(spark, docs, monkeypatch, cover, block):
    monkeypatch.setattr(dc, "BLOCK_WORDS", block)
    rng = random.Random(4)
    fill = lambda n: [f"w{rng.randrange(12)}" for _ in range(n)]
    items = [(i, " ".join(fill(rng.randint(1, 24)))) for i in range(12)] + [(50, None), (51, " ,. "), (None, "w1 W2, w3")]
    rows = []
    for d in range(60):
        parts = fill(rng.randint(0, 20))
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(items[:12])[1].split()
            cut = rng.randrange(len(p) + 1)
            parts += p[cut:] + fill(rng.randint(0, 1)) + p[:cut]
        rows.append((d, " ".join(parts)))
    rows += [(80, None), (81, ""), (82, "w1 w2"), (83, "W1 w2 w3")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = dc.contaminated(docs(rows), benchmark, cover).collect()
    want = brute_pairs(rows, items, cover)
    assert len(got) == len(want) > 20
    assert {tuple(r)[:6] for r in got} == want
    bad = {d for d, *_ in want}
    kept = {r.doc_id for r in dc.drop_contaminated(docs(rows), benchmark, cover).collect()}
    assert kept == {d for d, _ in rows} - bad


def test_repeated_rows_and_items(spark, docs):
    item = " ".join(f"q{i}" for i in range(20))
    benchmark = spark.createDataFrame([(1, item), (1, item), (2, item)], "item_id long, text string")
    d = docs([(1, item), (1, item), (2, item + " more"), (3, "clean")]).withColumnRenamed("lang", "t") \
        .withColumnRenamed("source", "text_id")
    got = sorted((r.doc_id, r.item_id) for r in dc.contaminated(d, benchmark).collect())
    assert got == [(1, 1), (1, 1), (1, 2), (1, 2), (2, 1), (2, 2)]
    kept = dc.drop_contaminated(d, benchmark)
    assert kept.columns == d.columns and [r.doc_id for r in kept.collect()] == [3]
