import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from shotspark.llm import archive
from shotspark.scale import scratch_path

ROWS = [
    (5, "http://a/x", "<p>one</p>"), (2, "http://b/y\r\nInjected: 1", "<p>one</p>"), (9, None, "<p>one</p>"),
    (2, "http://b/y", "<p>one</p>"), (1, "http://c", None), (3, "http://d", ""), (None, "http://e", "<p>only</p>"),
    (7, "http://f", "é漢"), (8, "http://g", "x" * 100_000), (4, "http://g", "x" * 100_000),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))


def expected(revisit_bytes=0):
    out = []
    for i, _, h in ROWS:
        body = (h or "").encode()
        ids = [j for j, _, g in ROWS if (g or "").encode() == body and j is not None]
        owner = min(ids) if ids and len(body) >= revisit_bytes else None
        revisit = owner is not None and i != owner
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((i, len(body), digest, "revisit" if revisit else "response", owner if revisit else None))
    return sorted(map(str, out))


@pytest.mark.parametrize("least", [0, 11])
def test_index(spark, pages, least):
    path = scratch_path(spark, "warc")
    archive.write_archive(pages, path, revisit_bytes=least)
    got = archive.read_index(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(str(tuple(r)) for r in got.collect()) == expected(least)


def test_payloads_once_and_records_whole(spark, pages):
    path = scratch_path(spark, "warc")
    archive.write_archive(pages, path)
    stored = [bytes(r["payload"]) for r in spark.read.parquet(f"{path}/payloads").collect()]
    assert sorted(stored) == sorted({(h or "").encode() for _, _, h in ROWS})
    for page, record in archive.read_records(spark, path).collect():
        head, _, body = bytes(record).partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        assert body.endswith(b"\r\n\r\n") and len(body) - 4 == int(fields[b"Content-Length"])
        assert b"Injected" not in fields
        if fields[b"WARC-Type"] == b"response":
            assert body[:-4].decode() in {h or "" for i, _, h in ROWS if i == page}


def test_damage_is_noticed(spark, pages):
    path = scratch_path(spark, "warc")
    archive.write_archive(pages, path)
    bad = spark.read.parquet(f"{path}/payloads").withColumn("payload", F.concat("payload", F.lit(b"!")))
    other = scratch_path(spark, "warc")
    bad.write.parquet(f"{other}/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{other}/headers")
    with pytest.raises(Exception, match="damaged"):
        archive.read_index(spark, other).collect()


def test_empty(spark):
    path = scratch_path(spark, "warc")
    archive.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert archive.read_index(spark, path).count() == 0


def test_query_is_the_sql(spark, sf):
    from workload.check import compare, duck

    problem, rows = compare(duck(sf), archive.op7_warc(spark, sf), archive.OP7_SQL)
    assert problem is None and rows
