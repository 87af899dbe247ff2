"""Content-addressed WARC archive.

An archive is two tables in one folder. ``payloads`` holds the bytes of each distinct payload once, under its SHA-256; ``headers``
holds the exact header bytes of every record, with the digest of its payload. Of records with equal payloads one is a response and
the others revisit it. Original records are reconstructed by a join on the digest; every payload read back is verified against its
digest. Records can be written out as ordinary ``.warc`` files and such files be read again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm.common import ship_by_value
from cohortry.sources.scratch import fresh_path

ship_by_value(__name__)

LEAST_BYTES = 0  # smaller payloads are always responses
DATE = "1970-01-01T00:00:00Z"
END = "\r\n\r\n"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_of_hex(hex_: Column) -> Column:
    """Upper-case base32 of the 40 hex digits of a SHA-1; five digits are four letters."""
    letters = []
    for i in range(8):
        bits = F.conv(F.substring(hex_, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(ALPHABET), F.shiftright(bits, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def payload_digest(payload: Column) -> Column:
    return base32_of_hex(F.sha1(payload))


def _record_id(id_: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(id_.cast("string"), F.lit("null")), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value. Line breaks in a value are percent-encoded."""
    safe = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


def write_archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least_bytes: int = LEAST_BYTES) -> None:
    """Write one record per row into ``folder``.

    Of rows with equal payload, those with the greatest id are responses, the others revisits; a null id is less than any other.
    Rows of equal id and payload are equal records. A null body is an empty payload, a null url has no target line.
    """
    read = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"),
        F.col(f"`{url_col}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{body_col}`"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    mark = F.xxhash64("payload")
    stored = read.groupBy("digest").agg(F.first("payload").alias("payload"), F.min(mark).alias("a"), F.max(mark).alias("b"))
    verified = F.when(F.col("a") == F.col("b"), F.col("payload")).otherwise(F.raise_error(F.lit("different payloads of one digest")))
    stored.select("digest", verified.alias("payload")).write.option("compression", "zstd").parquet(f"{folder}/payloads")

    facts = read.select(
        "page_id", "url", "digest", F.octet_length("payload").cast("long").alias("bytes"), payload_digest(F.col("payload")).alias("sha1")
    )
    facts.write.parquet(f"{folder}/facts")
    facts = pages.sparkSession.read.schema(facts.schema).parquet(f"{folder}/facts")
    first = facts.groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).filter("n > 1").drop("n")
    told = facts.join(first, "digest", "left")
    revisits = F.coalesce((F.col("bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("response")), F.lit(False)) & F.col("response").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    size = F.length(http) + F.when(revisits, F.lit(0)).otherwise(F.col("bytes"))
    warc = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisits, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", _record_id(F.col("page_id"))),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("WARC-Refers-To", F.when(revisits, _record_id(F.col("response")))),
        _line("WARC-Profile", F.when(revisits, F.lit(REVISIT_PROFILE))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", size.cast("string")),
        F.lit("\r\n"),
    )
    told.select(F.concat(warc, http).cast("binary").alias("header"), "digest").write.option("compression", "zstd").parquet(f"{folder}/headers")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """``header, payload``: the header bytes of every record and its full payload, verified; revisits get what they refer to."""
    headers = spark.read.schema("header binary, digest string").parquet(f"{folder}/headers")
    payloads = spark.read.schema("digest string, payload binary").parquet(f"{folder}/payloads")
    joined = headers.join(payloads, "digest", "left")
    right = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("no such payload: "), "digest")))
    return joined.select("header", right.alias("payload"))


def field(header: Column, name: str) -> Column:
    """A header field of a record, null if it has none."""
    found = F.regexp_extract(header.cast("string"), rf"\r\n{name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def original_records(archive: DataFrame) -> DataFrame:
    """``record, payload``: the bytes of each record as they would stand in a ``.warc`` file, without the two line ends that close it, and
    the full payload it stands for."""
    whole = F.when(field(F.col("header"), "WARC-Type") == "revisit", F.col("header")).otherwise(F.concat("header", "payload"))
    return archive.select(whole.alias("record"), "payload")


def parsed(records: DataFrame) -> DataFrame:
    """``header, http, payload``: the parts of each record, cut at its first two empty lines; a revisit has the payload it stands for.

    The block (``http`` and ``body``) must have the declared Content-Length in bytes; a response's body must be the payload, a
    revisit's must be empty; the block's own Content-Length must be the payload's. Anything else raises.
    """
    text = F.col("record").cast("string")
    cut = records.select(F.substring_index(text, END, 1).alias("header"), text.alias("_text"), "payload")
    block = F.substr("_text", F.length("header") + len(END) + 1)
    cut = cut.select("header", block.alias("_block"), "payload")
    cut = cut.select("header", F.substring_index("_block", END, 1).alias("http"), "_block", "payload")
    cut = cut.select("header", "http", F.substr("_block", F.length("http") + len(END) + 1).alias("body"), "_block", "payload")
    declared = field(F.col("header"), "Content-Length").cast("long")
    own = F.regexp_extract("http", r"\r\nContent-Length: (\d+)", 1).cast("long")
    expected = F.when(field(F.col("header"), "WARC-Type") == "revisit", F.lit("").cast("binary")).otherwise(F.col("payload"))
    right = (
        (F.octet_length("_block") == declared) & (own == F.octet_length("payload")) & (F.col("body").cast("binary") == expected)
    )
    payload = F.when(right, F.col("payload")).otherwise(F.raise_error(F.lit("a record is not as long as it declares")))
    return cut.select("header", "http", payload.alias("payload"))


def write_warc(records: DataFrame, path: str, records_per_file: int = 20_000) -> None:
    """Ordinary WARC files (uncompressed), one or more per task."""
    out = records.select(F.col("record").cast("string"))
    out.write.option("lineSep", END).option("maxRecordsPerFile", records_per_file).text(path)


def _parse(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 0
    while at < len(data):
        head = data.index(b"\r\n\r\n", at) + 4
        fields = dict(line.split(b": ", 1) for line in data[at:head].split(b"\r\n")[1:] if line)
        end = head + int(fields[b"Content-Length"])
        yield data[at:head], data[head:end]
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        at = end + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``header, block`` of every record of the WARC files in a folder, by their declared lengths. A file is read at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                found = list(_parse(data))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.binary())], names=["header", "block"]
                )

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "header binary, block binary")


def archived_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """The pages written to an archive in the shared folder and read back from its records.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to``, one row per page. Every record is rebuilt from its header and
    payload, cut into its parts and checked against its declared lengths; all values come from these. The payload's
    SHA-1 must be the one in the header. Repeated rows each have their row, null ids a null id. Other columns are not read.
    """
    spark = pages.sparkSession
    folder = fresh_path(spark)
    write_archive(pages, folder, id_col, url_col, body_col)
    back = parsed(original_records(read_archive(spark, folder))).withColumn("sha1", payload_digest(F.col("payload")))
    header = F.col("header")
    same = F.concat(F.lit("sha1:"), "sha1") == field(header, "WARC-Payload-Digest")
    number = lambda name: F.regexp_extract(field(header, name), r"^<urn:x-page:(-?\d+)>$", 1)
    as_id = lambda text: F.when(text != "", text).cast("long")
    return back.select(
        as_id(number("WARC-Record-ID")).alias(id_col),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(same, F.col("sha1")).otherwise(F.raise_error(F.lit("a payload does not have the digest in its header"))).alias("payload_digest"),
        field(header, "WARC-Type").alias("record_type"),
        as_id(number("WARC-Refers-To")).alias("refers_to"),
    )


_LETTERS = " || ".join(
    f"substr('{ALPHABET}', ((('0x' || substr(sha1, {5 * i + 1}, 5))::INTEGER >> {s}) & 31) + 1, 1)" for i in range(8) for s in (15, 10, 5, 0)
)
SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS sha1, max(page_id) OVER (PARTITION BY payload) AS response FROM p)
SELECT page_id, payload_bytes, {_LETTERS} AS payload_digest,
  CASE WHEN payload_bytes >= {LEAST_BYTES} AND page_id IS DISTINCT FROM response THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST_BYTES} AND page_id IS DISTINCT FROM response THEN response END AS refers_to
FROM d
"""
