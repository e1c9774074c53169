"""Parser edge rows (FIXTURES.md section 4) and fail-fast / quarantine modes."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ratecraft.sources import text


def _lines(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def test_whitespace_is_python_strip(spark):
    out = text.parse_ratings(_lines(spark, ["  1::2::0::978300769 \t"])).collect()
    assert [tuple(r) for r in out] == [(1, 2, 0.0, 978300769, 9)]


def test_extra_fields_ignored(spark):
    out = text.parse_ratings(_lines(spark, ["1::2::3.5::10::x"])).collect()
    assert [tuple(r) for r in out] == [(1, 2, 3.5, 10, 0)]


def test_negative_timestamp_bucket_is_never_negative(spark):
    out = text.parse_ratings(_lines(spark, ["1::2::3::-3"])).collect()
    assert out[0]["bucket"] == 7


def test_quarantine_routes_bad_lines(spark):
    good, bad = text.parse_ratings(
        _lines(spark, ["1::x::3::1", "bad", "3.0::1::1::1", "1::2::3::4", "1::2::z::4",
                       "1::2::3::t", "1099511627776::2::3::4"]), mode="quarantine")
    assert [tuple(r) for r in good.collect()] == [(1, 2, 3.0, 4, 4)]
    reasons = {r["line"]: r["reason"] for r in bad.collect()}
    assert reasons == {"1::x::3::1": "item_id", "bad": "too few fields",
                       "3.0::1::1::1": "user_id", "1::2::z::4": "rating", "1::2::3::t": "ts",
                       "1099511627776::2::3::4": "user_id"}


def test_failfast_raises_on_first_bad_line(spark):
    with pytest.raises(PySparkException, match="malformed rating line"):
        text.parse_ratings(_lines(spark, ["1::2::3::4", "bad"])).collect()


def test_failfast_check_survives_column_pruning(spark):
    # Only item_id is read, the bad field is the user id: still an error.
    with pytest.raises(PySparkException, match="malformed rating line"):
        text.parse_ratings(_lines(spark, ["x::2::3::4"])).select("item_id").collect()


def test_positive_loader_drops_zeros(spark):
    out = text.load_positive_ratings(_lines(spark, ["1::2::0::5", "1::3::4::5"])).collect()
    assert [r["item_id"] for r in out] == [3]


def test_items_title_cut_at_separator_and_unicode_kept(spark):
    out = text.parse_items(_lines(spark, ["7::A::B", "5::Café™", "  9::Padded title  "]))
    assert sorted(tuple(r) for r in out.collect()) == [(5, "Café™"), (7, "A"),
                                                      (9, "Padded title")]


def test_posted_body(spark):
    bodies = spark.createDataFrame([(3, "101,4\n102,2.5\n"), (4, "7,1")],
                                   "user_id int, body string")
    out = sorted(tuple(r) for r in text.parse_posted(bodies).collect())
    assert out == [(3, 101, 4.0), (3, 102, 2.5), (4, 7, 1.0)]


def test_roundtrip_format_parse(spark):
    rows = spark.createDataFrame([(1, 2, 3.5, 978300769)], "user_id int, item_id int, "
                                 "rating double, ts bigint")
    back = text.parse_ratings(text.format_rating_lines(rows)).drop("bucket")
    assert [tuple(r) for r in back.collect()] == [(1, 2, 3.5, 978300769)]


def test_empty_personal_ratings_raise(spark):
    empty = text.load_positive_ratings(_lines(spark, ["1::2::0::5"]))
    with pytest.raises(ValueError, match="no personal"):
        text.require_nonempty(empty, "personal ratings")


def test_parse_is_one_split_per_row(spark):
    # The split must not be copied into filters below the parse.
    df = text.load_positive_ratings(_lines(spark, ["1::2::3::4"])).where(F.col("bucket") == 4)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("split(") == 1


def test_nan_is_not_a_positive_rating_and_rejects_are_returned(spark):
    lines = spark.createDataFrame([("1::2::nan::5",), ("1::3::4::6",), ("1::4::0::7",), ("bad",)], "value string")
    good, rejects = text.load_positive_ratings(lines, mode="quarantine")
    assert [r.item_id for r in good.collect()] == [3]
    assert [tuple(r) for r in rejects.collect()] == [("bad", "too few fields")]
