"""WARC archives: writing captures, reading records back, assembling transactions.

A capture is written as three records: response (or revisit, for a payload seen before), request and metadata,
the last two naming the first in WARC-Concurrent-To. Records are rows of Spark's text writer, whose line end is
the two CRLF that close a record; so archives are committed like any Spark output, on any file system, and
executors may be lost. Archives are read by Content-Length alone, whatever their payloads hold, streamed in
bounded chunks from the compressed bytes, of which an archive may have 2 GB. Ours hold one gzip member each, not one for
each record, and no warcinfo record. Assembly joins the records by concurrent-to identifiers, across
archives, and emits one nested row per capture.

Defined results: a null html is an empty payload, a null url an urn of the page's record; white space and
control characters in a url are percent-encoded; rows that repeat a page_id are captures of their own, and of
equal payloads with equal page_ids one row is the response; a null page_id comes back null, last in that order.
Records other than these types are read and not assembled. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgewire.llm.common import pinned_splits, scratch_path, small_batches, stage

#: Payloads from this size on are written once.
LEAST_SHARED = 100
END = "\r\n\r\n"
_RECORD = "record_id string, type string, uri string, date string, concurrent_to string, refers_to string, digest string, block_bytes long, payload_bytes long, payload_digest string, payload binary, fields string"


def record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """One record without its closing line ends; headers that are null are left out."""
    lines = [F.lit("WARC/1.1")] + [F.concat(F.lit(f"{k}: "), v) for k, v in headers] + [F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)


def _urn(row: Column, part: int) -> Column:
    hexes = F.md5(F.concat_ws(":", row, F.lit(part)).cast("binary"))
    cut = [F.substring(hexes, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _clean_uri(url: Column) -> Column:
    """White space and control characters as %XX."""
    out = url
    for c in [*range(33), 127]:
        out = F.replace(out, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    return F.when(url.rlike(r"[\x00-\x20\x7F]"), out).otherwise(url)


def write_captures(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes pages (page_id, url, html) as archives under path. pages is read twice and should be a scan of files, so that
    its rows are numbered alike; a row that turns out to be another than when its payload was digested fails the job."""
    rows = pages.select(F.monotonically_increasing_id().alias("rid"), F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    size = F.octet_length("html").cast("long")
    rows = rows.select("*", size.alias("size"), F.sha2(F.col("html").cast("binary"), 256).alias("digest"))
    seen = stage(rows.select("rid", "page_id", "size", "digest"), "digests")
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "rid")
    firsts = seen.where(F.col("size") >= LEAST_SHARED).groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    again = seen.join(firsts, "digest").where(F.col("rid") != F.col("first")["rid"])
    again = again.select(F.col("rid").alias("of"), F.col("first")["rid"].alias("to"), F.col("first")["page_id"].alias("to_page"), F.col("page_id").alias("of_page"), F.col("digest").alias("of_digest"))
    rows = rows.join(stage(again, "revisits"), F.col("rid") == F.col("of"), "left")
    other = F.col("of").isNotNull() & ~((F.col("digest") == F.col("of_digest")) & F.col("page_id").eqNullSafe(F.col("of_page")))
    rows = rows.where(~F.when(other, F.raise_error(F.lit("the pages were numbered otherwise than when they were digested")).cast("boolean")).otherwise(F.lit(False)))

    key, revisit = F.col("rid").cast("string"), F.col("to").isNotNull()
    main = _urn(key, 0)
    uri = F.coalesce(_clean_uri(F.col("url")), F.concat(F.lit("urn:x-capture:"), key))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    when = F.lit(date)
    response = record(
        [
            ("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))), ("WARC-Record-ID", main), ("WARC-Date", when), ("WARC-Target-URI", uri),
            ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), ("WARC-Refers-To", _urn(F.col("to").cast("string"), 0)),
            ("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))), ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        F.when(revisit, http).otherwise(F.concat(http, F.col("html"))),
    )
    request = record([("WARC-Type", F.lit("request")), ("WARC-Record-ID", _urn(key, 1)), ("WARC-Date", when), ("WARC-Target-URI", uri), ("WARC-Concurrent-To", main), ("Content-Type", F.lit("application/http; msgtype=request"))], F.concat(F.lit("GET "), uri, F.lit(" HTTP/1.1" + END)))
    about = F.concat_ws("\r\n", F.concat(F.lit("page_id: "), F.col("page_id").cast("string")), F.concat(F.lit("refers_to: "), F.col("to_page").cast("string")), F.lit("via: sedgewire"))
    metadata = record([("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _urn(key, 2)), ("WARC-Date", when), ("WARC-Target-URI", uri), ("WARC-Concurrent-To", main), ("Content-Type", F.lit("application/warc-fields"))], about)
    out = rows.select(F.explode(F.array(request, response, metadata)).alias("value"))
    out.write.option("lineSep", END).option("compression", "gzip").text(path)


def _inflated(raw: memoryview | bytes) -> Iterator[bytes]:
    """The bytes of gzip members, in chunks, or as they are if not compressed."""
    if bytes(raw[:2]) != b"\x1f\x8b":
        for k in range(0, len(raw), 1 << 20):
            yield bytes(raw[k : k + (1 << 20)])
        return
    at, tool = 0, zlib.decompressobj(31)
    while at < len(raw):
        part = bytes(raw[at : at + (1 << 18)])
        at += len(part)
        yield tool.decompress(part)
        while tool.eof:
            part, tool = tool.unused_data, zlib.decompressobj(31)
            if not part:
                break
            yield tool.decompress(part)


def parse_records(raw: memoryview | bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of an archive."""
    held, chunks = bytearray(), _inflated(raw)

    def fill(n: int) -> bool:
        while len(held) < n:
            part = next(chunks, None)
            if part is None:
                return False
            held.extend(part)
        return True

    while True:
        while (end := held.find(END.encode())) < 0 or not held[:end].strip():
            if end >= 0:
                del held[: end + 4]
            elif not fill(len(held) + 1):
                return
        head = held[:end].decode("utf-8", "replace").strip().split("\r\n")
        del held[: end + 4]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head[1:])}
        n = int(headers.get("content-length", 0))
        if not fill(n):
            raise ValueError("an archive ends within a record")
        block = bytes(held[:n])
        del held[:n]
        yield headers, block


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([pa.field(x.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for x in _RECORD.split(", ")])
    for batch in batches:
        for content in batch.column(0):
            rows, held = [], 0
            for h, block in parse_records(memoryview(content.as_buffer())):
                http = "http" in h.get("content-type", "")
                payload = block.partition(END.encode())[2] if http else None
                digest = h.get("warc-payload-digest", "").partition(":")[2] or None
                if h.get("warc-type") == "revisit":
                    size = next((int(x.partition(b":")[2]) for x in block.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
                    payload, found = None, digest
                else:
                    size, found = (len(payload), hashlib.sha256(payload).hexdigest()) if http else (None, None)
                    if digest and found != digest:
                        raise ValueError(f"payload of {h.get('warc-record-id')} differs from its digest")
                fields = None if http else block.decode("utf-8", "replace")
                rows.append((h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-date"), h.get("warc-concurrent-to"), h.get("warc-refers-to"), digest, len(block), size, found, payload, fields))
                held += len(block)
                if held > 4 << 20 or len(rows) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives under path."""
    small_batches(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(_records, _RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit, with the request and metadata that are concurrent to it."""
    part = lambda *c: F.struct("record_id", "uri", "date", *c)
    main = records.where(F.col("type").isin("response", "revisit")).select(F.col("record_id").alias("capture_id"), "type", "refers_to", "payload_bytes", "payload_digest", part("payload").alias("response"))
    request = records.where("type = 'request'").select(F.col("concurrent_to").alias("capture_id"), part().alias("request"))
    metadata = records.where("type = 'metadata'").select(F.col("concurrent_to").alias("capture_id"), part("fields").alias("metadata"))
    return main.join(request, "capture_id", "left").join(metadata, "capture_id", "left")


def captures(pages: DataFrame) -> DataFrame:
    """Writes pages as archives in the shared folder, reads them back and assembles the captures, with their page_id
    and the page_id of the response that a revisit refers to."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    with pinned_splits(spark):
        write_captures(pages, path)
    field = lambda name: F.nullif(F.regexp_extract(F.col("metadata")["fields"], rf"(?:^|\n){name}: (-?\d+)", 1), F.lit("")).cast("long")
    return assemble(stage(read_records(spark, path).drop("payload"), "records").withColumn("payload", F.lit(None).cast("binary"))).select("*", field("page_id").alias("page_id"), field("refers_to").alias("refers_to_page"))
