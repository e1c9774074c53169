"""The block scorer against brute force on tables of its own, and how blocks are dealt."""

import numpy as np
import pyarrow as pa
import pytest

from ratecraft.operators import topn
from ratecraft.operators.exclusions import _codec


def _table(key, ids, vectors, **more):
    lists = pa.array([v.tolist() for v in vectors], pa.list_(pa.float32()))
    return pa.table({key: pa.array(ids, pa.int32()), "features": lists, **more})


def _brute(uids, U, iids, I, n, rated, floor):
    out = []
    for a, u in enumerate(uids):
        scores = np.zeros(len(iids))
        for d in range(U.shape[1]):
            scores = scores + U[a, d] * I[:, d]
        fine = [(-s, i) for s, i in zip(scores, iids) if i not in rated[a]]
        out += [(u, i, -s) for s, i in sorted(fine)[:n] if not -s < floor[a]]
    return sorted(out)


@pytest.mark.parametrize("kind", ["plain", "ties", "outlier", "repeated ids", "tiny"])
def test_scorer_matches_brute_force(monkeypatch, kind):
    monkeypatch.setattr(topn, "SCORE_CHUNK_BYTES", 4 * 700)      # several steps a chunk
    rng = np.random.default_rng(5)
    U, I = rng.normal(size=(40, 6)).astype(np.float32), rng.normal(size=(1900, 6)).astype(np.float32)
    iids = rng.permutation(1900) + 7
    if kind == "ties":
        U, I = np.round(U), np.round(I)
    if kind == "outlier":
        I[5] *= 1e9
    if kind == "repeated ids":
        iids = iids // 2
    if kind == "tiny":
        U, I = U * np.float32(1e-30), I * np.float32(1e-12)
    U[3], I[11] = 0, 0
    ranked = np.unique(iids)
    encode, _ = _codec()
    rated, seen = [], []
    for a in range(len(U)):
        at = np.flatnonzero(rng.random(len(ranked)) < (0, 0.02, 0.995)[a % 3])
        rated.append({int(x) for x in ranked[at]})
        seen.append(encode(at) if len(at) else None)
    U64, I64 = U.astype(np.float64), I.astype(np.float64)
    floor = [None if a % 4 else float(np.sort(U64[a] @ I64.T)[-4]) for a in range(len(U))]
    users = _table("user_id", range(40), U, seen=pa.array(seen, pa.binary()), floor=pa.array(floor, pa.float64()))
    score = topn._block_scorer(5, max_chunk=7, most_rated=2500)
    got = score(users, _table("item_id", iids, I))
    want = _brute(range(40), U64, iids, I64, 5, rated, [-np.inf if f is None else f for f in floor])
    rows = sorted(zip(*(got[c].to_pylist() for c in ("user_id", "item_id", "score"))))
    assert rows == [(u, int(i), s) for u, i, s in want]


def test_large_item_blocks_and_more_user_blocks():
    """Each item block gives every user one more list: few of them, however many cores."""
    size = topn.block_size(10)
    users, items = topn.plan_blocks(900_000, 1_200_000, 12, size, size)
    assert items == 5 and users * items >= 96
    users, items = topn.plan_blocks(100, 50_000, 12, size, size)
    assert users * items >= 96 and users <= 100
