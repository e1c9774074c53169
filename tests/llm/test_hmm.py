"""Counts and base score against Python; the recursions against all paths."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ratecraft.llm import hmm


def test_forward_and_expected_counts_match_all_paths():
    rng = np.random.default_rng(0)
    n, k = hmm.CLASSES + 1, 3
    start, move, emit = rng.dirichlet([1] * k), rng.dirichlet([1] * k, k), rng.dirichlet([1] * n, k).T
    size = np.array([3, 1, 5, 2])
    cls = rng.integers(0, n, 11)
    off = np.concatenate([[0], np.cumsum(size)])
    logs = hmm.forward((start, move, emit), size, cls, off)[0]
    want = [np.zeros(k), np.zeros((k, k)), np.zeros((n, k))]
    for q in range(4):
        o = cls[off[q]:off[q + 1]]
        total, counts = 0, [np.zeros(k), np.zeros((k, k)), np.zeros((n, k))]
        for z in itertools.product(range(k), repeat=len(o)):
            p = start[z[0]] * emit[o[0], z[0]]
            for t in range(1, len(o)):
                p *= move[z[t - 1], z[t]] * emit[o[t], z[t]]
            total += p
            counts[0][z[0]] += p
            for t in range(len(o)):
                counts[2][o[t], z[t]] += p
                if t:
                    counts[1][z[t - 1], z[t]] += p
        assert math.log10(total) == pytest.approx(logs[q])
        for a, b in zip(want, counts, strict=True):
            a += b / total
    for a, b in zip(want, hmm.expected((start, move, emit), size, cls, off), strict=False):
        assert np.abs(a - b).max() < 1e-9


def base(rows):
    def tokens(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]

    train = [t for d, t in rows if zlib.crc32(b"" if d is None else str(d).encode()) % 7 != 2]
    c = Counter(w for t in train for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return n, {(d, t): (len(tokens(t)), sum(c[w] > 0 for w in tokens(t)),
                        sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t))) for d, t in rows}


def corpus():
    rng = np.random.default_rng(3)
    rows = []
    for i in range(120):
        words = [f"{'a' if i % 2 else 'Ö'}{x}" for x in rng.zipf(1.5, rng.integers(0, 80)) % 500]
        rows.append((i, " ".join(words)))
    return rows + [(901, None), (902, ""), (None, "zz a1"), (903, "A1 a1"), (903, "A1 a1"), (903, "b"),
                   (904, "a1 a2 " * 3000)]


@pytest.mark.parametrize("head", [hmm.HEAD, 20])
def test_scores(docs, monkeypatch, head):
    monkeypatch.setattr(hmm, "HEAD", head)
    rows = corpus()
    n, want = base(rows)
    got = hmm.hmm_scores(docs(rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for d, t in rows:
        tokens, known, score = want[(d, t)]
        assert any((r.n_tokens, r.n_known, r.train_tokens) == (tokens, known, n)
                   and r.base_score == pytest.approx(score, rel=1e-9) for r in by[d])
    assert any(r.held_out for r in got) and all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_held_out_texts_are_likelier_than_by_counts_alone(spark):
    from ratecraft.llm.common import load
    from tests.conftest import SF_MID
    held = [r for r in hmm.hmm_scores(load(spark, SF_MID, "documents")).collect() if r.held_out]
    tokens = sum(r.n_tokens for r in held)
    assert sum(r.score for r in held) / tokens > sum(r.base_score for r in held) / tokens + 0.05


def test_training_raises_the_likelihood(docs, spark):
    from pyspark.sql import functions as F
    rows = docs(corpus()).select(F.col("doc_id").alias("key"), F.lit(True).alias("train"),
                                 F.coalesce("text", F.lit("")).alias("text")).na.fill(0)
    packed = rows.mapInArrow(hmm._pack, "part int, seq int, keys array<bigint>, train binary, sizes binary, classes binary")
    _, history = hmm.baum_welch(packed)
    gains = np.diff(history)
    assert gains[0] > 0 and (gains[:-1] >= hmm.TOLERANCE).all() and gains[-1] < hmm.TOLERANCE


def test_no_rows(docs):
    assert hmm.hmm_scores(docs([(1, "x")]).where("doc_id = 2")).collect() == []


def em_round(model, texts):
    """One round of Baum-Welch, a text and a token at a time."""
    start, move, emit = model
    k = len(start)
    starts, moves, emits = (np.full(x.shape, hmm.PRIOR) for x in model)
    total = 0.0
    for o in texts:
        alpha, scale = [], []
        for t, c in enumerate(o):
            a = (start if t == 0 else alpha[-1] @ move) * emit[c]
            scale.append(a.sum())
            alpha.append(a / a.sum())
        total += sum(map(math.log10, scale))
        beta = np.ones(k)
        for t in range(len(o) - 1, -1, -1):
            post = alpha[t] * beta
            emits[o[t]] += post
            if t:
                after = emit[o[t]] * beta / scale[t]
                moves += np.outer(alpha[t - 1], after) * move
                beta = move @ after
            else:
                starts += post
    return (starts / starts.sum(), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=0)), \
        total / sum(map(len, texts))


@pytest.mark.parametrize("states", [hmm.STATES, 2])
def test_scores_match_brute_force(docs, states):
    rows = corpus()[:60] + [(901, None), (902, ""), (None, "zz a1"), (903, "b")]

    def split(t):
        h, _, _ = hmm.hash_words(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]), True)
        return h.tolist()

    def classes(t):
        return [int(c) for c in hmm.class_of(np.array([*split(t), 0], np.uint64))]

    train = [t for d, t in rows if zlib.crc32(b"" if d is None else str(d).encode()) % 7 != 2]
    count = Counter(w for t in train for w in split(t))
    below = Counter()
    for w, n in count.items():
        below[int(hmm.class_of(np.array([w], np.uint64))[0])] += n + 1
    model, history = hmm._starting_model(states), []
    while len(history) < 2 or history[-1] - history[-2] >= hmm.TOLERANCE:
        model, likely = em_round(model, [classes(t) for t in train])
        history.append(likely)
    got = {(r.doc_id, r.n_tokens): r.score for r in hmm.hmm_scores(docs(rows), states=states).collect()}
    start, move, emit = model
    for d, t in rows:
        a, want = start, 0.0
        for i, c in enumerate(classes(t)):
            a = (a if i == 0 else a @ move) * emit[c]
            want += math.log10(a.sum())
            a = a / a.sum()
        want += sum(math.log10((count[w] + 1) / (below[int(hmm.class_of(np.array([w], np.uint64))[0])] + 1)) for w in split(t))
        assert got[d, len(split(t)) + 1] == pytest.approx(want, rel=1e-9)
