import base64
import hashlib

import pytest

from ratecraft.llm import warc_archive as wa


@pytest.fixture
def pages(spark):
    rows = [(1, "u", "<a>"), (2, None, "<a>"), (3, "x\r\ny", "<b>é"), (4, "u", None), (5, "u", ""), (None, "u", "<a>"),
            (None, "u", "q"), (6, "u", "<b>é"), (6, "u", "<b>é"), (7, "v", "z" * 70000)]
    return spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, address int").repartition(3)


def test_report(pages):
    got = sorted((tuple(r) for r in wa.archive_report(pages).collect()), key=str)
    sha = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    a, b = "<a>", "<b>é"
    want = [(1, 3, sha(a), "revisit", 2), (2, 3, sha(a), "response", None), (3, 5, sha(b), "revisit", 6),
            (4, 0, sha(""), "revisit", 5), (5, 0, sha(""), "response", None), (None, 3, sha(a), "revisit", 2),
            (None, 1, sha("q"), "response", None), (6, 5, sha(b), "response", None), (6, 5, sha(b), "response", None),
            (7, 70000, sha("z" * 70000), "response", None)]
    assert got == sorted(want, key=str)


def test_small_payloads_are_not_shared(pages):
    got = wa.archive_report(pages, least=4).where("payload_bytes < 4")
    assert {r.record_type for r in got.collect()} == {"response"}


def test_payloads_are_stored_once_and_records_come_back(spark, pages, shared):
    path = shared("warc-test")
    wa.write_archive(pages, path)
    assert spark.read.parquet(f"{path}/payloads").count() == 5
    records = {r.page_id: bytes(r.record) for r in wa.original_records(spark, path).collect()}
    head, _, body = records[1].partition(b"\r\n\r\n")
    assert body == b"<a>\r\n\r\n" and b"WARC-Type: response" in head and b"Content-Length: 3" in head
    assert b"WARC-Target-URI: x%0D%0Ay" in records[3]


def test_damaged_payload_fails(spark, pages, shared):
    path = shared("warc-damaged")
    wa.write_archive(pages, path)
    from pyspark.sql import functions as F
    bad = spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit(b"changed"))
    bad.write.parquet(f"{path}/payloads2")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{path}-2/headers")
    spark.read.parquet(f"{path}/payloads2").write.parquet(f"{path}-2/payloads")
    with pytest.raises(Exception, match="damaged payload"):
        wa.read_archive(spark, f"{path}-2").collect()


def test_no_pages(pages):
    assert wa.archive_report(pages.where("page_id = 99")).collect() == []
