"""Components against all pairs; every way through the operator."""

import itertools
import random

import pytest

from ratecraft.llm import jaccard


def brute(rows, k, num, den):
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append(set(zip(*[w[x:] for x in range(k)], strict=False)) if len(w) >= k else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            parent[find(a)] = find(b)
    least = {}
    for j, (i, _) in enumerate(rows):
        if sets[j] and i is not None:
            least[find(j)] = min(least.get(find(j), i), i)
    return sorted(((i, len(sets[j]), least.get(find(j)) if sets[j] else i) for j, (i, _) in enumerate(rows)), key=str)


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]

    def near(base, most):
        copy = list(base)
        for _ in range(rng.randint(0, most)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        return copy

    texts = []
    for _ in range(30):
        base = [rng.choice(words) for _ in range(rng.randint(1, 120))]
        texts += [base] + [near(base, 3) for _ in range(rng.randint(0, 3))]
    hot = [rng.choice(words) for _ in range(150)]
    texts += [near(hot, 6) for _ in range(70)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rows += [(9000, None), (9001, ""), (9002, " \n "), (None, "w1 w2"), (9003, "W1 w2"), (9004, "w1 w2"),
             (9005, "long tail " * 3000), (9006, "long tail " * 3001), (3, rows[3][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("k,num,den,star,tile", [(3, 90, 100, 256, 1024), (5, 80, 100, 8, 40), (2, 60, 100, 8, 1024)])
def test_components_match_brute_force(docs, monkeypatch, k, num, den, star, tile):
    monkeypatch.setattr(jaccard, "STAR", star)
    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(jaccard, "SLICE", 16)
    rows = corpus()
    got = jaccard.jaccard_groups(docs(rows), k, num, den).select("doc_id", "n_shingles", "component_id")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, k, num, den)


def test_keep_one_keeps_the_smallest_of_each_component(docs):
    rows = corpus()
    d = docs(rows)
    kept = jaccard.keep_one(d, 3, 90, 100)
    assert kept.columns == d.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    want = {i for i, n, c in brute(rows, 3, 90, 100) if n and i is not None and i == c}
    blank = [9000, 9001, 9002]
    assert ids == sorted([*want, *blank], key=str)


def test_no_rows(docs):
    none = docs([(1, "x")]).where("doc_id = 2")
    assert jaccard.jaccard_join(none).collect() == [] and jaccard.keep_one(none).collect() == []


def test_a_dispersed_group_is_not_all_its_pairs(docs, monkeypatch):
    """Copies edited at about the threshold: few link to the hub, most to some other."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(240):
        copy = list(base)
        for _ in range(rng.randint(1, 4)):
            copy[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    formed = {}
    real = jaccard.written

    def counted(df, name):
        out = real(df, name)
        if name == "candidates":
            formed[jaccard.NEAREST] = out.count()
        return out

    monkeypatch.setattr(jaccard, "written", counted)
    monkeypatch.setattr(jaccard, "STAR", 64)
    want = brute(rows, 5, 80, 100)
    for rounds in (0, 2):
        monkeypatch.setattr(jaccard, "NEAREST", rounds)
        got = jaccard.jaccard_groups(docs(rows), 5, 80, 100).select("doc_id", "n_shingles", "component_id")
        assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert formed[2] < 0.25 * formed[0]
