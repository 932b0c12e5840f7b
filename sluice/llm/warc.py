"""Operator 2, content-addressed WARC archive.

An archive is two tables in a folder:
  payloads  key (SHA-256 of the bytes), payload: the bytes of every different payload, once
  records   key and the exact header bytes of every record: WARC header, blank line, HTTP header, blank line
Reading joins them on the key. A payload whose SHA-256 is not its key, or a record without its payload, fails the
read; so does a rebuilt record whose content is not as long as its header says. Digest and length of a payload are
computed once for each stored payload, below the join; a plan that does not ask for payload or record bytes does not
move them. Records of one payload may be a large part of all rows: storing combines them before the shuffle, and reading
is a plain equi-join whose skewed partitions Spark splits.

Of records with equal payloads of at least `least` bytes, the one with the largest page_id is the response and the
others revisit it (identical-payload-digest); smaller payloads are responses all. Rows that repeat the largest
page_id with the same payload cannot be told apart and are responses all. Null html is the empty payload. A null
page_id or url leaves its header field out; a null page_id is a response only if all of its payload are null. Line
feeds, carriage returns and other white space in a url are percent-encoded. An empty table gives an empty archive.
Other columns are not archived.

`export` writes the rebuilt records as .warc.gz files, `parse` reads such files, and `pages` says of each record in them
what page it is, after its bytes have been held against the digest and the lengths that its headers state.
"""

from __future__ import annotations

import gzip
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def _line(name: str, value: Column) -> Column:
    """A header line, empty if its value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))


def _safe(url: Column) -> Column:
    for sign in "\r\n\t \x0b\x0c":
        url = F.replace(url, F.lit(sign), F.lit(f"%{ord(sign):02X}"))
    return url


def write(pages: DataFrame, path: str, least: int = 1000, date: str = DATE) -> None:
    """pages: page_id, url, html. Writes an archive to the folder `path`, which all executors reach."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("key", F.unhex(F.sha2("payload", 256)))
    store = rows.groupBy("key").agg(F.first("payload").alias("payload"))
    store.write.option("compression", "zstd").parquet(f"{path}/payloads")

    heads = rows.select("page_id", "url", "key", F.length("payload").alias("size"), F.sha1("payload").alias("sha1"))
    first = heads.filter(F.col("size") >= least).groupBy("key").agg(F.max("page_id").alias("response"), F.lit(True).alias("large"))
    heads = heads.join(first, "key", "left")
    revisit = F.col("large").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    http = F.concat(F.lit(HTTP), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    body = F.length(http) + F.when(revisit, 0).otherwise(F.col("size"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _record_id(F.col("page_id"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", _safe(F.col("url"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("WARC-Refers-To", F.when(revisit, _record_id(F.col("response")))),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", body.cast("string")),
        F.lit("\r\n"),
        http,
    )
    heads.select("key", header.cast("binary").alias("header")).write.parquet(f"{path}/records")


def field(header: Column, name: str) -> Column:
    """A field of header bytes; null if it is not there."""
    value = F.regexp_extract(header.cast("string"), rf"(?:^|\r\n){name}: ([^\r\n]*)\r\n", 1)
    return F.when(value != "", value)


def _page(value: Column) -> Column:
    return F.regexp_extract(value, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every record of an archive: page_id, record_type, refers_to, url, payload_digest and payload_bytes (of the full
    payload, a revisit's too), payload, record (the exact bytes, with the two line ends that close it)."""
    store = spark.read.schema("key binary, payload binary").parquet(f"{path}/payloads")
    records = spark.read.schema("key binary, header binary").parquet(f"{path}/records")
    intact = F.unhex(F.sha2("payload", 256)) == F.col("key")
    store = store.select(
        "key",
        F.when(intact, F.length("payload")).otherwise(F.raise_error(F.lit("a payload differs from its digest"))).cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("sha1"),
        "payload",
    )
    joined = records.join(store, "key", "left")
    head = F.col("header")
    kind = field(head, "WARC-Type")
    stated = F.concat(F.lit("sha1:"), F.col("sha1"))
    record = F.concat("header", F.when(kind == "revisit", F.lit(b"")).otherwise(F.col("payload")), F.lit(b"\r\n\r\n"))
    block = F.octet_length(F.substring_index(head.cast("string"), "\r\n\r\n", 1)) + 4
    whole = F.length(record) == block + field(head, "Content-Length").try_cast("long") + 4
    return joined.select(
        _page(field(head, "WARC-Record-ID")).alias("page_id"),
        kind.alias("record_type"),
        _page(field(head, "WARC-Refers-To")).alias("refers_to"),
        field(head, "WARC-Target-URI").alias("url"),
        F.when(field(head, "WARC-Payload-Digest") == stated, F.col("sha1"))
        .otherwise(F.raise_error(F.lit("a record has no payload with the digest that it states")))
        .alias("payload_digest"),
        "payload_bytes",
        "payload",
        F.when(whole, record).otherwise(F.raise_error(F.lit("a record is not as long as it states")).cast("binary")).alias("record"),
    )


def export(records: DataFrame, path: str) -> None:
    """Writes `record` bytes as gzipped .warc files (part files) under `path`. Spark's text sink writes a string's bytes as
    they are, and its line separator is what closes a record."""
    body = F.substring("record", F.lit(1), F.length("record") - 4)
    records.select(body.cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def split(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """WARC header block and content block of each record in a file's bytes."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        fields = dict(x.split(b": ", 1) for x in data[at:end].split(b"\r\n")[1:] if x)
        n = int(fields[b"Content-Length"])
        yield data[at:end], data[end : end + n]
        if data[end + n : end + n + 4] != b"\r\n\r\n":
            raise ValueError("a record is not closed")
        at = end + n + 4


def parse(spark: SparkSession, path: str) -> DataFrame:
    """header and content of every record in the .warc files under `path`, gzipped or plain; one file at a time is in
    memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("content").to_pylist():
                if data[:2] == b"\x1f\x8b":
                    data = gzip.decompress(data)
                for some in itertools.batched(split(data), 256):
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*some, strict=True)], ["header", "content"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, "header binary, content binary")


def pages(parsed: DataFrame) -> DataFrame:
    """Every record of .warc files, from its bytes alone: page_id, record_type, refers_to, url, payload_digest and
    payload_bytes (of the full payload, a revisit's too). A response whose payload has not the digest that it states fails
    the query; so does a record whose HTTP header states another length than its payload, or the payload that it revisits,
    has."""
    head, content = F.col("header"), F.col("content")
    block = F.octet_length(F.substring_index(content.cast("string"), "\r\n\r\n", 1)) + 4
    payload = F.substring(content, block + 1, F.length(content) - block)
    stated = F.regexp_extract(F.substring(content, F.lit(1), block).cast("string"), r"Content-Length: (\d+)\r\n", 1).try_cast("long")
    rows = parsed.select(
        _page(field(head, "WARC-Record-ID")).alias("page_id"),
        field(head, "WARC-Type").alias("record_type"),
        _page(field(head, "WARC-Refers-To")).alias("refers_to"),
        field(head, "WARC-Target-URI").alias("url"),
        F.substring_index(field(head, "WARC-Payload-Digest"), ":", -1).alias("payload_digest"),
        stated.alias("payload_bytes"),
        F.length(payload).cast("long").alias("held"),
        F.sha1(payload).alias("sha1"),
    )
    whole = (F.col("record_type") == "revisit") | (F.col("sha1") == F.col("payload_digest")) & (F.col("held") == F.col("payload_bytes"))
    checked = F.when(F.coalesce(whole, F.lit(False)), F.col("payload_bytes")).otherwise(F.raise_error(F.lit("a record's payload is not what its header states")).cast("long"))
    rows = rows.withColumn("payload_bytes", checked)
    own = rows.filter("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("there"))
    good = (F.col("record_type") == "response") | (F.col("there") == F.col("payload_bytes"))
    size = F.when(F.coalesce(good, F.lit(False)), F.col("payload_bytes")).otherwise(F.raise_error(F.lit("a revisit refers to no such response")).cast("long"))
    return rows.join(own, ["refers_to", "payload_digest"], "left").select("page_id", "record_type", "refers_to", "url", "payload_digest", size.alias("payload_bytes"))
