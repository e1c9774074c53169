"""Exact split sizes by selection, and moments that don't cancel."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from ratecraft.functions import selection
from ratecraft.functions.splits import row_key
from ratecraft.operators import evaluate, splits


@pytest.mark.parametrize("few", [0, 3, 4096])
def test_kth_smallest(spark, monkeypatch, few):
    monkeypatch.setattr(selection, "FEW", few)
    rng = random.Random(few)
    keys = [hashlib.md5(str(rng.randrange(300)).encode()).hexdigest() for _ in range(2000)] + ["0" * 32] * 700
    df = spark.createDataFrame([(k,) for k in keys], "key string").repartition(7)
    keys.sort()
    ranks = [1, 2, 699, 700, 701, 1500, 2700]
    for r, (key, below, equal) in zip(ranks, selection.kth_smallest(df, ranks), strict=True):
        assert key == keys[r - 1] and below == keys.index(key) and equal == keys.count(key)
    with pytest.raises(ValueError):
        selection.kth_smallest(df, [2701])


def _split(df):
    out = splits.with_split(df, "exact")
    assert out.columns == [*df.columns, "split"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.mark.parametrize("n", [0, 1, 3, 4, 10, 1003])
def test_sizes_are_exact_on_any_partitioning(spark, n):
    df = spark.range(n).select(F.col("id").cast("int").alias("user_id"), (F.col("id") % 7).cast("int").alias("item_id"),
                               (F.col("id") % 5).cast("double").alias("rating"), F.col("id").alias("ts"))
    got = _split(df.repartition(1))
    sizes = {s: sum(r[-1] == s for r in got) for s in ("train", "validation", "test")}
    assert sizes == {"train": n * 6 // 10, "validation": n * 8 // 10 - n * 6 // 10, "test": n - n * 8 // 10}
    assert got == _split(df.repartition(9, "item_id"))
    ordered = sorted((hashlib.md5(f"{u}|{i}|{r}|{t}|24".encode()).hexdigest(), s) for u, i, r, t, s in got)
    assert [s for _, s in ordered] == ["train"] * sizes["train"] + ["validation"] * sizes["validation"] + ["test"] * sizes["test"]


@pytest.mark.parametrize("copies", [50, 900])
def test_a_cut_among_equal_rows(spark, copies):
    rows = [(u, 1, None, 5) for u in range(40)] + [(99, 9, 2.0, None)] * copies
    df = spark.createDataFrame(rows, "user_id int, item_id int, rating double, ts long").repartition(5)
    got = _split(df)
    n = len(rows)
    assert sorted((r[:4] for r in got), key=repr) == sorted(rows, key=repr)
    assert [sum(r[4] == s for r in got) for s in ("train", "validation", "test")] == \
        [n * 6 // 10, n * 8 // 10 - n * 6 // 10, n - n * 8 // 10]
    assert got == _split(df.repartition(2))


def test_keys_tell_nulls_from_text(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), ("", "a")], "x string, y string")
    assert df.select(row_key(24, df.columns).alias("k")).distinct().count() == 3


def test_pairwise_error_does_not_cancel(spark):
    rng = random.Random(6)
    rows = [("test", rng.randrange(8), rng.randrange(6), rng.uniform(0, 5), rng.uniform(0, 5)) for _ in range(400)]
    names = "split string, user_id int, item_id int, rating double, prediction double"
    want = math.sqrt(sum((p - a) ** 2 for s, u, i, _, p in rows for t, v, j, a, _ in rows if (u, i) == (v, j))
                     / sum((u, i) == (v, j) for _, u, i, _, _ in rows for _, v, j, _, _ in rows))
    for shift in (0.0, 1e8):
        df = spark.createDataFrame([(s, u, i, a + shift, p + shift) for s, u, i, a, p in rows], names)
        assert abs(evaluate.rmse_pairwise(df).first()["rmse"] - want) < 1e-6
