"""Content-addressed WARC archive.

Every record's exact header is kept; payload bytes are stored once, under their
SHA-256. An archive is two Parquet tables below one folder: ``headers`` (a WARC
header a page, whose X-Content-Address names the payload) and ``payloads``
(address, bytes). Reading parses the headers, checks every stored payload
against its address, and joins the two, which gives the original records back.

Of records with equal payloads of at least ``least`` bytes the one with the
largest page_id is the response and the others revisit it. That is one maximum
an address, with partial aggregation; the maxima of addresses that many pages
share are broadcast (a bounded number), so such pages don't meet in one task.
Payloads themselves are moved once, by (address, page_id).

DataFrame functions only. Defined results: null html is an empty payload; a null
url gives no target header; line ends in a url are percent-encoded; a null
page_id is smaller than every other (a group of nulls alone: all response); rows
with the largest page_id that repeat are all responses; an empty table gives an
empty archive; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ratecraft.llm.common import met
from ratecraft.session import scratch_path

#: Smallest payload that is shared.
LEAST = 0
WARC_DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EOL = "\r\n"


def base32_of_hex(hexed):
    """Base 32 (RFC 4648) of 20 bytes in hexadecimal: 5 hex digits are 20 bits
    and 4 letters."""
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _line(name, value):
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(_EOL)), F.lit(""))


def _urn(page):
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def write_archive(pages: DataFrame, path: str, least: int = LEAST) -> None:
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("address", F.sha2("payload", 256))
    narrow = rows.select("page_id", "url", "address", F.octet_length("payload").alias("size"),
                         base32_of_hex(F.sha1("payload")).alias("sha1"))
    owners = rows.groupBy("address").agg(F.max("page_id").alias("owner"), F.count("*").alias("n"))
    shared = (F.col("size") >= least) & F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    h = met(narrow, owners, "address").withColumn("refers_to", F.when(shared, F.col("owner")))
    revisit = F.col("refers_to").isNotNull()
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    header = F.concat(
        F.lit(f"WARC/1.1{_EOL}"), _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _urn(F.col("page_id"))), _line("WARC-Date", F.lit(WARC_DATE)),
        _line("WARC-Target-URI", url), _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("X-Content-Address", F.concat(F.lit("sha256:"), F.col("address"))),
        _line("WARC-Refers-To", F.when(revisit, _urn(F.col("refers_to")))),
        _line("WARC-Profile", F.when(revisit, REVISIT)), _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(revisit, "0").otherwise(F.col("size").cast("string"))), F.lit(_EOL))
    h.select(header.alias("header")).write.parquet(f"{path}/headers")

    # The owner's row holds the payload; rows that repeat it give one.
    key = F.coalesce(F.col("page_id"), F.lit(0))
    own = owners.select("address", F.coalesce("owner", F.lit(0)).alias("key"))
    once = Window.partitionBy("address", "key").orderBy("address")
    rows.select("address", key.alias("key"), "payload").join(own, ["address", "key"]) \
        .withColumn("nth", F.row_number().over(once)).where("nth = 1") \
        .select("address", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")


def _field(name):
    return F.regexp_extract("header", rf"\r\n{name}: ([^\r]*)\r\n", 1)


def read_archive(spark, path: str) -> DataFrame:
    """``page_id, url, record_type, refers_to, header, payload, payload_bytes,
    payload_digest`` of each record; a payload that differs from its address
    fails the job."""
    stored = spark.read.schema("address string, payload binary").parquet(f"{path}/payloads")
    sound = F.sha2("payload", 256) == F.col("address")
    stored = stored.select(
        "address", "payload",
        F.when(sound, F.octet_length("payload").cast("long"))
        .otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("address")))).alias("payload_bytes"),
        base32_of_hex(F.sha1("payload")).alias("payload_digest"))
    page = lambda name: F.regexp_extract(_field(name), "<urn:page:(-?[0-9]+)>", 1)
    number = lambda c: F.when(c != "", c).try_cast("long")
    url = _field("WARC-Target-URI")
    heads = spark.read.schema("header string").parquet(f"{path}/headers").select(
        "header", number(page("WARC-Record-ID")).alias("page_id"), F.when(url != "", url).alias("url"),
        _field("WARC-Type").alias("record_type"), number(page("WARC-Refers-To")).alias("refers_to"),
        F.regexp_extract("header", r"\r\nX-Content-Address: sha256:([0-9a-f]{64})\r\n", 1).alias("address"))
    return heads.join(stored, "address").drop("address")


def original_records(spark, path: str) -> DataFrame:
    """``page_id, record``: every page's record as crawled, header and payload,
    whether its archive entry is a response or a revisit."""
    r = read_archive(spark, path)
    header = F.regexp_replace("header", r"(?<=\r\n)(WARC-Refers-To|WARC-Profile|X-Content-Address): [^\r]*\r\n", "")
    header = F.regexp_replace(header, r"WARC-Type: revisit", "WARC-Type: response")
    size = F.concat(F.lit("Content-Length: "), F.col("payload_bytes").cast("string"))
    header = F.regexp_replace(header, r"Content-Length: [0-9]+", size)
    return r.select("page_id", F.concat(header.cast("binary"), F.col("payload"),
                                        F.lit(_EOL * 2).cast("binary")).alias("record"))


def archive_report(pages: DataFrame, least: int = LEAST) -> DataFrame:
    path = scratch_path(pages.sparkSession, "warc")
    write_archive(pages, path, least)
    return read_archive(pages.sparkSession, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
