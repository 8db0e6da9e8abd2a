"""The WARC source and archives of pages with revisits."""

import base64
import gzip
import hashlib
import io
import os

import pyarrow as pa
import pytest
from llm.conftest import ODD_TEXTS
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from tacitrec.llm import warc
from tacitrec.llm.warc import (
    WarcReader,
    archived_pages,
    encode_record,
    gzip_member,
    read_archive,
    read_records,
    with_revisits,
    write_archive,
)

RECORDS = [
    {"record_id": "urn:a", "record_type": "response", "target_uri": "http://x/1", "payload": b"one" * 50_000, "content_type": "text/html"},
    {"record_id": "urn:b", "record_type": "revisit", "target_uri": "http://x/2", "payload_length": 150_000, "refers_to": "urn:a"},
    {"record_id": "urn:c", "record_type": "response", "target_uri": None, "payload": b"", "content_type": None},
    {"record_id": "urn:d", "record_type": "metadata", "target_uri": "ftp://é \r\nWARC-Type: evil", "payload": b"WARC/1.1\r\n\r\nWARC/1.1\r\n\r\n"},
    {"record_id": "urn:e", "record_type": "response", "target_uri": "http://y", "payload": os.urandom(300_000)},
]


def base32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@pytest.mark.parametrize("packing", [gzip_member, gzip.compress, bytes], ids=["sl", "plain gzip", "not packed"])
@pytest.mark.parametrize("payload", [True, False])
def test_records_of_any_packing(packing, payload):
    data = b"".join(packing(encode_record(r)) for r in RECORDS)
    found = list(read_records(pa.BufferReader(data), "f", payload=payload))
    assert [(r["record_id"], r["record_type"], r["refers_to"]) for r in found] == [
        (r["record_id"], r["record_type"], r.get("refers_to")) for r in RECORDS
    ]
    assert [r["payload_length"] for r in found] == [150_000, 150_000, 0, 24, 300_000]
    assert [r["payload"] for r in found] == [r.get("payload", b"") if payload else None for r in RECORDS]
    assert found[3]["target_uri"] == "ftp://%C3%A9%20%0D%0AWARC-Type:%20evil"
    assert found[0]["payload_digest"] == "sha1:" + base32(RECORDS[0]["payload"]) and found[1]["payload_digest"] is None
    own = list(read_records(pa.BufferReader(data), "f", [D.EqualTo(("record_id",), "urn:d")]))
    assert [r["payload"] for r in own] == [RECORDS[3]["payload"]]


class Counting(io.BytesIO):
    taken = 0

    def readinto(self, buffer):
        n = super().readinto(buffer)
        self.taken += n
        return n


def test_unwanted_payloads_are_stepped_over():
    big = [{"record_id": f"urn:{i}", "record_type": "response", "payload": os.urandom(2_000_000)} for i in range(4)]
    for packing in (gzip_member, bytes):
        handle = Counting(b"".join(packing(encode_record(r)) for r in big))
        assert list(read_records(handle, "f", [D.EqualTo(("record_type",), "revisit")])) == []
        assert handle.taken < 4 * 4 * warc.CHUNK


def test_broken_files_stop_the_job():
    whole = gzip_member(encode_record(RECORDS[0]))
    for data in (b"not an archive", whole[:-40], whole + b"junk", encode_record(RECORDS[0])[:2000]):
        with pytest.raises(ValueError):
            list(read_records(pa.BufferReader(data), "f"))


def test_filters_follow_sql():
    record = {"record_type": "response", "refers_to": None, "content_length": 7}
    cases = [
        (D.EqualTo(("refers_to",), "x"), None), (D.Not(D.EqualTo(("refers_to",), "x")), None), (D.IsNull(("refers_to",)), True),
        (D.EqualNullSafe(("refers_to",), None), True), (D.In(("record_type",), ("a", "response")), True),
        (D.In(("record_type",), ("a", None)), None), (D.Not(D.In(("record_type",), ("a",))), True), (D.GreaterThan(("content_length",), 7), False),
        (D.LessThanOrEqual(("content_length",), 7), True), (D.StringStartsWith(("record_type",), "res"), True), (D.IsNotNull(("refers_to",)), False),
    ]
    for test, expected in cases:
        assert warc.holds(test, record) is expected


def test_predicates_reach_the_reader():
    reader = WarcReader({"path": "/nowhere"})
    tests = [D.EqualTo(("record_type",), "response"), D.EqualTo(("payload",), b""), D.StringContains(("target_uri",), "x"), D.IsNull(("headers",))]
    assert list(reader.pushFilters(tests)) == [tests[1], tests[3]]
    assert reader.tests == [tests[0], tests[2]]


def test_archive_round_trip(spark, tmp_path):
    path = str(tmp_path / "archive")
    rows = [(r["record_id"], r["record_type"], r.get("target_uri"), r.get("payload"), r.get("refers_to")) for r in RECORDS]
    records = spark.createDataFrame(rows, "record_id string, record_type string, target_uri string, payload binary, refers_to string")
    write_archive(records.withColumn("other", F.lit(1)).repartition(2), path, filebytes=100)
    with open(f"{path}/lost.warc.gz", "wb") as lost:  # a file of an attempt that never committed
        lost.write(gzip_member(encode_record(RECORDS[0])))
    found = {r["record_id"]: r for r in read_archive(spark, path, splitbytes=1).collect()}
    assert {k: bytes(r["payload"]) for k, r in found.items()} == {r[0]: r[3] or b"" for r in rows}
    assert sum(n.endswith(".warc.gz") for n in os.listdir(path)) > 3
    some = read_archive(spark, path).filter("record_type = 'response' and target_uri like 'http://x%' and octet_length(payload) > 0")
    assert [r["record_id"] for r in some.collect()] == ["urn:a"]
    reader = WarcReader({"path": path, "splitbytes": "1"})
    list(reader.pushFilters([D.EqualTo(("record_type",), "metadata")]))
    assert len(reader.partitions()) == 1  # the commit says which files hold which types
    write_archive(records, path)
    assert read_archive(spark, path).count() == 2 * len(rows)
    records.limit(1).write.format("warc").mode("overwrite").save(path)
    assert read_archive(spark, path).count() == 1


def plain_pages(rows, least):
    payloads = [(html or "").encode() for _, html in rows]
    result = []
    for (page, _), payload in zip(rows, payloads):
        ids = [p for (p, _), other in zip(rows, payloads) if other == payload]
        keep = max((p for p in ids if p is not None), default=None)
        kept = len(payload) < least or page == keep
        result.append((str(page), len(payload), base32(payload), "response" if kept else "revisit", None if kept else keep))
    return sorted(result, key=str)


@pytest.mark.parametrize("least", [0, 10])
def test_equal_payloads_are_revisits(spark, tmp_path, least):
    rows = [(i, html) for i, html in enumerate(ODD_TEXTS)]
    rows += [(100 + i, "same payload of many pages" if i % 2 else "short") for i in range(60)] + [(None, "same text"), (None, "alone"), (7, "x"), (7, "x")]
    pages = spark.createDataFrame([(p, f"http://h/{i}\n" if i % 3 else None, h) for i, (p, h) in enumerate(rows)], "page_id bigint, url string, html string")
    pages = pages.withColumn("payload", F.lit("clash")).withColumn("key", F.lit(1))
    path = str(tmp_path / "pages")
    write_archive(with_revisits(pages, least_bytes=least), path)
    found = [(str(r["page_id"]), *r[1:]) for r in archived_pages(spark, path).collect()]
    assert sorted(found, key=str) == plain_pages(rows, least)


def test_hot_payloads_are_spread(spark, tmp_path):
    pages = spark.range(12_000).select(F.col("id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("html"))
    path = str(tmp_path / "hot")
    write_archive(with_revisits(pages), path)
    rows = archived_pages(spark, path).groupBy("record_type").agg(F.count("*").alias("n"), F.max("refers_to").alias("to")).collect()
    assert sorted(map(tuple, rows)) == [("response", 6001, None), ("revisit", 5999, 11_998)]


def test_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    path = str(tmp_path / "none")
    write_archive(with_revisits(empty), path)
    assert archived_pages(spark, path).count() == 0
