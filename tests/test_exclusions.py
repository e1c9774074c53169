"""Compressed exclusion sets: every container, sizes, and user blocks by size."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ratecraft.operators import exclusions as ex
from ratecraft.operators import topn

ENCODE, DECODE = ex._codec()


@settings(deadline=None, max_examples=200)
@given(st.sets(st.one_of(st.integers(0, 300), st.integers(0, 200_000)), min_size=1, max_size=400))
def test_sets_come_back(numbers):
    pos = np.array(sorted(numbers))
    blob = ENCODE(pos)
    assert DECODE(blob).tolist() == pos.tolist()
    wide = 4 if pos[-1] >= 1 << 16 else 2
    assert len(blob) <= 1 + min(wide * len(pos), int(pos[-1]) // 8 + 1)


def test_the_smallest_container_is_taken():
    kinds = {"array": np.array([3, 900, 40_000]), "runs": np.arange(50, 5000), "bitmap": np.arange(0, 4000, 2),
             "wide": np.arange(70_000, 140_000)}
    blobs = {k: ENCODE(v) for k, v in kinds.items()}
    assert {k: b[0] for k, b in blobs.items()} == {"array": 0, "runs": 1, "bitmap": 2, "wide": 5}
    assert {k: len(b) for k, b in blobs.items()} == {"array": 7, "runs": 5, "bitmap": 1 + 3998 // 8 + 1, "wide": 9}
    assert all(DECODE(blobs[k]).tolist() == kinds[k].tolist() for k in kinds)


def _exclude(spark):
    rows = [(u, i) for u in range(40) for i in range(300) if (u * 31 + i * 7) % 11 == 0] * 2
    rows += [(5, i) for i in range(300)] + [(6, i) for i in range(0, 300, 2)] + [(7, 9999)]
    return spark.createDataFrame([*rows, (None, 3)], "user_id int, item_id int").repartition(4), \
        {(u, i) for u, i in rows if i < 300}


def test_pairs_and_sizes(spark):
    exclude, want = _exclude(spark)
    items = spark.range(300).select(F.col("id").cast("int").alias("item_id"), (F.col("id") % 3).cast("int").alias("ib"))
    numbers = ex.numbered(items)
    assert numbers.agg(F.min("pos"), F.max("pos")).first()[:] == (0, 99)
    sets = ex.excluded_sets(exclude, numbers)
    assert sorted(map(tuple, ex.excluded_pairs(sets, numbers).collect())) == sorted(want)
    size = {(r.user_id, r.ib): len(r.seen) for r in sets.collect()}
    assert all(size[5, b] == 5 for b in range(3))  # one run
    whole = max(sum(n for (_, b), n in size.items() if b == k) for k in range(3))
    assert ex.max_group_bytes(sets, 1) == whole
    blocks = ex.user_blocks_within(sets, 1, whole // 3, 41)
    assert blocks >= 4 and ex.max_group_bytes(sets, blocks) <= whole // 3
    assert ex.user_blocks_within(sets, 1, 0, 41) == 41
    assert ex.excluded_sets(exclude.where("item_id < 0"), numbers).collect() == []


def test_a_small_budget_makes_more_user_blocks_and_the_same_rows(spark, monkeypatch):
    exclude, want = _exclude(spark)
    rng = np.random.default_rng(4)
    users, items = rng.integers(-2, 3, (40, 3)), rng.integers(-2, 3, (300, 3))
    uf = spark.createDataFrame([(u, [float(x) for x in users[u]]) for u in range(40)], "user_id int, features array<float>")
    itf = spark.createDataFrame([(i, [float(x) for x in items[i]]) for i in range(300)], "item_id int, features array<float>")
    got = sorted(map(tuple, topn.top_n_by_dot(uf, itf, 4, exclude).collect()))
    rows = []
    for u in range(40):
        best = sorted((-float(users[u] @ items[i]), i) for i in range(300) if (u, i) not in want)[:4]
        rows += [(u, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(rows)
    asked = []
    real = ex.max_group_bytes
    monkeypatch.setattr(ex, "max_group_bytes", lambda sets, n: asked.append(n) or real(sets, n))
    monkeypatch.setattr(topn, "GROUP_BUDGET_BYTES", 300)
    monkeypatch.setattr(topn, "MIN_BLOCK", 64)
    assert sorted(map(tuple, topn.top_n_by_dot(uf, itf, 4, exclude).collect())) == got
    assert asked and asked[0] < 40
