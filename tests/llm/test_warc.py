import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from cohortry.llm import warc as W

ROWS = [
    (1, "http://a.example/", "same"), (5, "http://b.example/", "same"), (3, None, "same"), (2, "http://c.example/\r\nX: y", None), (4, "u", ""), (7, "v", "é\r\n\r\nWARC/1.1\r\n"),
    (8, "w", "z" * 300_000), (8, "w", "z" * 300_000), (None, "n", "same"), (9, "o", "alone"),
]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, 1, "p") for r in rows], "page_id long, url string, html string, digest int, payload string")


def test_pages_come_back(spark):
    got = sorted((tuple(r) for r in W.archived_pages(pages(spark)).collect()), key=str)
    want = []
    for i, _, html in ROWS:
        raw = (html or "").encode()
        response = max((j for j, _, h in ROWS if (h or "") == (html or "") and j is not None), default=None)
        sha = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        want.append((i, len(raw), sha, *(("response", None) if i == response else ("revisit", response))))
    assert got == sorted(want, key=str)


def test_small_payloads_are_responses(spark, tmp_path):
    W.write_archive(pages(spark), str(tmp_path / "a"), least_bytes=10)
    back = W.read_archive(spark, str(tmp_path / "a"))
    kinds = back.select(W.field(F.col("header"), "WARC-Type").alias("t"), F.octet_length("payload").alias("n")).collect()
    assert all(r["t"] == "response" for r in kinds if r["n"] < 10) and len(kinds) == len(ROWS)
    assert spark.read.parquet(str(tmp_path / "a/payloads")).count() == len({h or "" for _, _, h in ROWS})


def test_damaged_payloads_are_noticed(spark, tmp_path):
    W.write_archive(pages(spark), str(tmp_path / "a"))
    stored = spark.read.parquet(str(tmp_path / "a/payloads")).withColumn("payload", F.concat("payload", F.lit("!").cast("binary")))
    W_folder = tmp_path / "b"
    stored.write.parquet(str(W_folder / "payloads"))
    spark.read.parquet(str(tmp_path / "a/headers")).write.parquet(str(W_folder / "headers"))
    with pytest.raises(Exception, match="no such payload"):
        W.read_archive(spark, str(W_folder)).collect()


def test_files_round_trip(spark, tmp_path):
    W.write_archive(pages(spark), str(tmp_path / "a"))
    records = W.original_records(W.read_archive(spark, str(tmp_path / "a")))
    want = sorted(bytes(r["record"]) for r in records.collect())
    W.write_warc(records, str(tmp_path / "w"), records_per_file=3)
    got = sorted(bytes(r["header"]) + bytes(r["block"]) for r in W.read_warc(spark, str(tmp_path / "w")).collect())
    assert got == want and all(x.startswith(b"WARC/1.1\r\nWARC-Type: ") for x in want)


def test_empty_table(spark):
    assert W.archived_pages(pages(spark, [])).count() == 0


def test_records_that_are_not_as_declared_are_refused(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/x", "body of one"), (2, "http://a/y", "body of one"), (3, None, "")], "page_id long, url string, html string")
    W.write_archive(pages, str(tmp_path / "a"))
    records = W.original_records(W.read_archive(spark, str(tmp_path / "a")))
    assert W.parsed(records).count() == 3 and {bytes(r["payload"]) for r in W.parsed(records).collect()} == {b"body of one", b""}
    text = F.col("record").cast("string")
    for damaged in (F.concat(text, F.lit("!")), F.replace(text, F.lit("Content-Length: 11"), F.lit("Content-Length: 12")), F.replace(text, F.lit("body"), F.lit("bode"))):
        with pytest.raises(Exception, match="not as long as it declares"):
            W.parsed(records.withColumn("record", damaged.cast("binary"))).collect()
