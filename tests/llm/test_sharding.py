import zlib
from collections import defaultdict

import numpy as np
import pytest

from ratecraft.llm import sharding


def test_fisher_yates_is_a_uniform_permutation():
    seen = defaultdict(int)
    for seed in range(6000):
        p = sharding.fisher_yates(3, [seed])
        assert sorted(p) == [0, 1, 2]
        seen[tuple(p)] += 1
    assert len(seen) == 6 and max(seen.values()) < 1.2 * min(seen.values())
    assert sharding.fisher_yates(0, [1]).tolist() == [] and sharding.fisher_yates(1, [1]).tolist() == [0]


@pytest.mark.parametrize("bucket", [8 << 20, 300])
def test_report(docs, monkeypatch, bucket):
    monkeypatch.setattr(sharding, "BUCKET_BYTES", bucket)
    rows = [(i, f"text {i % 90} é") for i in range(500)] + [(500, None), (501, ""), (None, "n"), (None, "m"), (7, "again"),
                                                            (8, "text 8 é")]
    got = sharding.shard_report(docs(rows)).collect()
    assert len(got) == len(rows)
    slots, place = defaultdict(list), defaultdict(set)
    texts = defaultdict(set)
    for i, t in rows:
        texts[i].add((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())))
    for r in got:
        slots[r.shard].append(r.slot)
        place[r.doc_id].add(r.shard)
        assert (r.size, r.text_crc32) in texts[r.doc_id]
        assert r.law == "key" and r.grown_shard in (r.shard, sharding.SHARDS)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in place.values())
    grown = {r.doc_id: r.grown_shard for r in got}
    more = {r.doc_id: r.shard for r in sharding.shard_report(docs(rows), sharding.SHARDS + 1).collect()}
    assert grown == more


def test_columns_and_order(docs):
    d = docs([(i, f"t{i}") for i in range(200)])
    out = sharding.sharded(d, 2)  # the column named shard is replaced
    assert sorted(out.columns) == sorted([*d.columns, "slot"])
    order = [r.doc_id for r in out.where("shard = 0").orderBy("slot").collect()]
    assert order != sorted(order) and np.unique(order).size == len(order)
    assert sharding.sharded(d.where("doc_id < 0")).collect() == []


def test_no_other_column_is_lost(docs):
    names = ["bucket", "place", "deal", "grown_shard", "offset", "BUCKET_"]
    d = docs([(i, f"t{i}") for i in range(50)] + [(None, None)])
    for j, name in enumerate(names):
        d = d.withColumn(name, d.doc_id * 10 + j)
    out = sharding.sharded(d, 3)
    assert sorted(out.columns) == sorted([*d.columns, "slot"])
    rows = [r for r in out.collect() if r.doc_id is not None]
    assert len(rows) == 50
    assert all(r[name] == r.doc_id * 10 + j for r in rows for j, name in enumerate(names))
