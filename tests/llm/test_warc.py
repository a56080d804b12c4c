import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from cliptide.llm import warc
from cliptide.session import scratch_path

PAGES = [
    (3, "http://a/ b", "same é", "x"), (1, "http://c", "same é", "y"), (2, None, None, "z"), (5, "http://d", "", "z"),
    (9, "http://e", "other\r\n\r\nWARC-Type: revisit\r\n", "z"), (9, "http://e", "other\r\n\r\nWARC-Type: revisit\r\n", "z"), (None, "http://f", "same é", None),
    (12, "http://g", "long " * 50_000, "z"),
]
SCHEMA = "page_id long, url string, html string, digest string"


def digest(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def test_records_come_back_whole(spark):
    df = spark.createDataFrame(PAGES, SCHEMA)
    found = warc.read(spark, warc.write(df)).collect()
    assert len(found) == len(PAGES)
    for r in found:
        body = next((h or "") for p, _, h, _ in PAGES if p == r.page_id)
        assert r.payload.decode() == body and r.payload_sha1 == digest(body) and r.payload_bytes == len(body.encode())
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ") and r.header.encode() == head + b"\r\n\r\n"
        length = int(head.split(b"Content-Length: ")[1])
        assert rest == rest[:length] + b"\r\n\r\n"
        assert length == (len(body.encode()) if r.record_type == "response" else 0)
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in found)
    assert kinds == [
        (0, "revisit", 1), (1, "response", None), (2, "response", None), (3, "revisit", 1), (5, "revisit", 2),
        (9, "response", None), (9, "response", None), (12, "response", None),
    ]


def test_payloads_are_stored_once(spark):
    path = warc.write(spark.createDataFrame(PAGES, SCHEMA))
    stored = spark.read.parquet(f"{path}/payloads")
    assert stored.count() == 4 == stored.select("digest").distinct().count()


def test_small_payloads_are_all_responses(spark):
    found = warc.read(spark, warc.write(spark.createDataFrame(PAGES, SCHEMA), min_bytes=8)).collect()
    assert {r.record_type for r in found if r.payload_bytes < 8} == {"response"}


def test_empty_table(spark):
    assert warc.read(spark, warc.write(spark.createDataFrame([], SCHEMA))).count() == 0


def test_damage_is_found(spark):
    path = warc.write(spark.createDataFrame([(1, "u", "body")], "page_id long, url string, html string"))
    damaged = scratch_path(spark, "damaged")
    spark.read.parquet(f"{path}/records").write.parquet(f"{damaged}/records")
    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.encode(F.lit("bodY"), "utf-8")).write.parquet(f"{damaged}/payloads")
    with pytest.raises(Exception, match="damaged payload of page 1"):
        warc.read(spark, damaged).collect()
