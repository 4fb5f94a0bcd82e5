"""WARC archives: write captures with their transactions, read records, and assemble captures again.

A capture is written as three records: the response, or a revisit when its payload is that of another capture; the
request; and metadata with the page's id. Request and metadata name the response in WARC-Concurrent-To. Reading
parses all records of all files and joins the three kinds on these identifiers to one nested row per capture.

Archives go through Spark's text writer: records hold text, and its line separator is the separator of records, so files
are committed like any other output, in whatever store the path is in. They come back through the binary file reader,
and are unpacked as a stream, record by record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

#: fixed values of the format
SEPARATOR = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
#: captures in a file at most
FILE_CAPTURES = 20_000
_BATCH = 500


def base32_sha1(raw: Column) -> Column:
    """Bare base32 SHA-1: five hex digits make four characters."""
    h = F.sha1(raw)
    quads = [F.lpad(F.conv(h.substr(1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*quads), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[h.substr(a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _record(fields: list[tuple[str, Column]], block: Column) -> Column:
    """A record without the separator behind it; fields that are null are left out."""
    lines = [F.lit("WARC/1.1"), *[F.concat(F.lit(f"{k}: "), v) for k, v in fields]]
    return F.concat(F.concat_ws("\r\n", *lines, F.concat(F.lit("Content-Length: "), F.octet_length(block))), F.lit(SEPARATOR), block)


def write_archives(pages: DataFrame, path: str, least: int = 0, date: str = DATE, file_captures: int = FILE_CAPTURES) -> None:
    """Writes each row of ``pages`` (page_id, url, html) as response or revisit, request and metadata.

    Of rows with equal payloads of at least ``least`` bytes the one with the smallest page_id is the response. Fixed
    results: a null html is an empty payload; rows that repeat the smallest page_id are responses too; null ids revisit
    if any row of their group has an id, else they are responses; a null url leaves its field out; line ends in a
    url become spaces; an empty table makes an archive without records; other columns are not read.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", F.regexp_replace("url", "[\r\n]", " ").alias("url"), html.alias("html"), F.octet_length(html).alias("size"), base32_sha1(html).alias("digest"))
    same = rows.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    same = cut_lineage(same.where("n > 1").select(F.col("digest").alias("d"), "first"))
    rows = rows.join(same, F.col("digest") == F.col("d"), "left").withColumn("number", F.monotonically_increasing_id())
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = rows.select("*", again.alias("again"), _uuid(F.col("page_id"), F.col("digest"), F.col("number")).alias("id"))
    at = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("url"))]
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size"), F.lit(SEPARATOR))
    kind = F.when(F.col("again"), "revisit").otherwise("response")
    response = _record(
        [("WARC-Type", kind), ("WARC-Record-ID", F.col("id")), *at, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
         ("WARC-Profile", F.when(F.col("again"), F.lit(PROFILE))), ("Content-Type", F.lit("application/http;msgtype=response"))],
        F.when(F.col("again"), http).otherwise(F.concat(http, F.col("html"))),
    )
    url = F.coalesce("url", F.lit(""))
    target = F.regexp_extract(url, "^[^:]*://[^/?#]*([^#]*)", 1)
    request = _record(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", _uuid(F.col("id"), F.lit("request"))), *at,
         ("WARC-Concurrent-To", F.col("id")), ("Content-Type", F.lit("application/http;msgtype=request"))],
        F.concat(F.lit("GET "), F.when(target == "", "/").otherwise(target), F.lit(" HTTP/1.1\r\nHost: "), F.regexp_extract(url, "://([^/?#]*)", 1), F.lit(SEPARATOR)),
    )
    about = F.concat(F.lit("via: pages\r\n"), F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit("")))
    metadata = _record(
        [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _uuid(F.col("id"), F.lit("metadata"))), *at,
         ("WARC-Concurrent-To", F.col("id")), ("Content-Type", F.lit("application/warc-fields"))],
        about,
    )
    records = rows.select(F.explode(F.array(request, response, metadata)).alias("value"))
    records.write.option("lineSep", SEPARATOR).option("compression", "gzip").option("maxRecordsPerFile", 3 * file_captures).text(path)


def _fields(lines: list[bytes]) -> dict[str, str]:
    pairs = (x.decode("utf-8", "replace").partition(":") for x in lines)
    return {k.strip().lower(): v.strip() for k, _, v in pairs if k.strip()}


def records_of(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an unpacked stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        head = []
        while (line := stream.readline()).strip():
            head.append(line)
        fields = _fields(head)
        length = int(fields.get("content-length", 0))
        block = stream.read(length)
        if len(block) < length:
            raise ValueError("a record is cut short")
        yield fields, block


_RECORD = pa.schema([
    ("record_id", pa.string()), ("kind", pa.string()), ("concurrent_to", pa.string()), ("target_uri", pa.string()), ("date", pa.string()),
    ("digest", pa.string()), ("first_line", pa.string()), ("fields", pa.map_(pa.string(), pa.string())),
    ("payload_bytes", pa.int64()), ("payload", pa.binary()),
])
RECORD = (
    "record_id string, kind string, concurrent_to string, target_uri string, date string, digest string, first_line string,"
    " fields map<string,string>, payload_bytes bigint, payload binary"
)


def _row(fields: dict[str, str], block: bytes, payloads: bool) -> dict:
    kind = fields.get("warc-type")
    head, _, payload = block.partition(b"\r\n\r\n") if kind in ("response", "revisit", "request") else (block, b"", b"")
    lines = head.split(b"\r\n")
    row = {"record_id": fields.get("warc-record-id"), "kind": kind, "concurrent_to": fields.get("warc-concurrent-to"), "target_uri": fields.get("warc-target-uri"), "date": fields.get("warc-date")}
    row |= {"fields": list(_fields(lines[1:] if kind != "metadata" else lines).items()), "first_line": lines[0].decode("utf-8", "replace") if kind != "metadata" else None}
    if kind == "response":  # of the bytes themselves, not of what the header says
        row |= {"digest": base64.b32encode(hashlib.sha1(payload).digest()).decode(), "payload_bytes": len(payload), "payload": payload if payloads else None}
    elif kind == "revisit":
        row |= {"digest": (fields.get("warc-payload-digest") or "").removeprefix("sha1:") or None}
    return row


def read_records(spark: SparkSession, path: str, payloads: bool = True, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """A row for each record of all files below ``path``; payloads only if asked for."""
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, stream = [], io.BytesIO(content.as_py())
                if stream.getbuffer()[:2] == b"\x1f\x8b":
                    stream = io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 16)
                for fields, block in records_of(stream):
                    if kinds is None or fields.get("warc-type") in kinds:
                        rows.append(_row(fields, block, payloads))
                    if len(rows) == _BATCH:
                        yield pa.RecordBatch.from_pylist(rows, _RECORD)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _RECORD)

    return files.mapInArrow(run, RECORD)


def assemble(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One nested row per capture: capture_id, kind, target_uri, date, digest, page_id, refers_to, payload_bytes, payload,
    and the request and metadata records that are concurrent to it.

    A capture without a request or metadata has null there; of several the one with the smallest record id counts; records
    that are concurrent to nothing in the archives are no captures. ``refers_to`` is the page_id of the response with
    a revisit's digest, whose payload size the revisit takes over.
    """
    read = cut_lineage(read_records(spark, path, payloads=False).drop("payload"))
    sides = read.where("kind in ('request', 'metadata') and concurrent_to is not null")
    one = F.struct("record_id", "first_line", F.map_entries("fields").alias("fields"))
    sides = sides.groupBy("concurrent_to", "kind").agg(F.min_by(one, "record_id").alias("r"))
    request, metadata = (sides.where(F.col("kind") == k).select(F.col("concurrent_to").alias(f"{k}_of"), F.col("r").alias(k)) for k in ("request", "metadata"))
    main = read.where("kind in ('response', 'revisit')")
    if payloads:
        held = read_records(spark, path, True, ("response", "revisit")).select("record_id", "payload")
        main = main.join(held, "record_id")
    whole = main.join(request, F.col("record_id") == F.col("request_of"), "left").join(metadata, F.col("record_id") == F.col("metadata_of"), "left")
    page = F.map_from_entries("metadata.fields")["page-id"].cast("bigint")
    whole = whole.select(F.col("record_id").alias("capture_id"), "kind", "target_uri", "date", "digest", page.alias("page_id"), "payload_bytes", *(["payload"] if payloads else []), "request", "metadata")
    narrow = cut_lineage(whole.select("kind", "digest", "page_id", "payload_bytes"))
    # written, so that the join below can split a digest that most revisits share
    firsts = narrow.where("kind = 'response'").groupBy(F.col("digest").alias("d")).agg(F.min("page_id").alias("first"), F.max("payload_bytes").alias("size"))
    wanted = narrow.where("kind = 'revisit'").select(F.col("digest").alias("d")).distinct()
    firsts = cut_lineage(firsts.join(wanted, "d", "left_semi"))
    again = F.col("kind") == "revisit"
    out = whole.join(firsts, again & (F.col("digest") == F.col("d")), "left")
    return out.withColumn("payload_bytes", F.coalesce("payload_bytes", "size")).withColumn("refers_to", F.when(again, F.col("first"))).drop("d", "first", "size")
