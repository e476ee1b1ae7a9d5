"""Legacy ARC archives converted to WARC.

An ARC file starts with a ``filedesc`` record whose block states the version and names
the fields of all later header lines (five in version 1, ten in version 2).  Each header
line ends with the declared length of its block.  The converter turns records into WARC
records with synthesised identifiers, dates, types and digests; of records with equal
payloads one stays a response, the others become revisits of it.

Archives are gzip files of at most ``FILE_RECORDS`` records, written by Spark's text
writer with the record separator of the format, and read record by record.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterloom.llm.common import batches
from meterloom.session import shared_dir, stage

LEAST = 100  # bytes from which equal payloads become revisits
FILE_RECORDS = 2000
_FLUSH = 4 << 20  # bytes of records gathered before a batch goes back to Spark

# Field names of the two ARC versions, the revisit profile.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ORIGIN = "meterloom"
PAGE_HEADER = b"X-Page-Id"


# ---- ARC -----------------------------------------------------------------------------


def arc_description(name: str, date: str, version: int) -> bytes:
    """The ``filedesc`` record of an archive, without the newline that separates records."""
    block = f"{version} 0 {ORIGIN}\n{FIELDS[version]}\n\n".encode()
    blank = " 200 - - 0 -" if version == 2 else ""
    # the version block's own last newline serves as the separator of records
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{blank} {len(block)}\n".encode() + block


def arc_record(uri: str, date: str, block: bytes, version: int, name: str, number: int) -> bytes:
    middle = f" 200 {hashlib.md5(block).hexdigest()} - {number} {name}" if version == 2 else ""
    return f"{uri} 0.0.0.0 {date} text/html{middle} {len(block)}\n".encode() + block


def _uri(url: str | None, page: int | None) -> str:
    """An address without white space, so that header lines split at it."""
    safe = "".join(c if c.isprintable() and not c.isspace() else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    return safe or f"urn:page:{'' if page is None else page}"


def write_arc(pages: DataFrame, path: str, version: int = 1, records: int = FILE_RECORDS) -> None:
    """Write ``page_id, url, date, html`` rows as ARC files of one version.

    Every row becomes a record (repeated rows too) with an HTTP response as its block;
    null html is an empty body, a null or empty url a ``urn:page`` address, a null date
    the start of the epoch.
    """

    def run(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, count, out, size = "", 0, [], 0
        for batch in batches(iterator):
            for row in batch.to_pylist():
                body = (row["html"] or "").encode()
                date = row["date"] or "19700101000000"
                page = row["page_id"]
                if count % records == 0:
                    name = f"{hashlib.sha256(repr((page, row['url'])).encode()).hexdigest()[:16]}.arc"
                    out.append(arc_description(name, date, version))
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                head += b"" if page is None else b"%s: %d\r\n" % (PAGE_HEADER, page)
                block = head + b"Content-Length: %d\r\n\r\n" % len(body) + body
                out.append(arc_record(_uri(row["url"], page), date, block, version, name, count % records))
                count, size = count + 1, size + len(block)
                if size > _FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    _write(pages.select("page_id", "url", "date", "html").mapInArrow(run, "record binary"), path, "\n", records + 1)


def _write(records: DataFrame, path: str, separator: str, most: int) -> None:
    """Binary rows as they are, each followed by ``separator``, in gzip files."""
    (
        records.select(F.col("record").cast("string").alias("value"))
        .write.option("lineSep", separator)
        .option("compression", "gzip")
        .option("zlib.compress.level", "BEST_SPEED")
        .option("maxRecordsPerFile", most)
        .text(path)
    )


def parse_arc(stream: BinaryIO) -> Iterator[dict]:
    """Records of an ARC stream as ``offset, kind, uri, ip, date, mime, block``.

    Header lines are read by the fields that the last ``filedesc`` block names.  At a
    line that does not fit, or a block shorter than declared, the rest of the stream is
    given as one record of kind ``damaged``.
    """
    fields = FIELDS[1].split()
    while True:
        offset, line = stream.tell(), stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        described = line.startswith(b"filedesc://")
        text = line.decode("utf-8", "surrogateescape").rstrip("\r\n")
        # a filedesc line comes before its fields are known: only its first and last ones matter
        values = text.rsplit(" ", text.count(" ") if described else len(fields) - 1)
        length = values[-1]
        if not length.isdigit() or not (described or len(values) == len(fields)) or len(values) < 5:
            yield {"offset": offset, "kind": "damaged", "block": line + stream.read()}
            return
        block = stream.read(int(length))
        if len(block) < int(length):
            yield {"offset": offset, "kind": "damaged", "block": line + block}
            return
        names = FIELDS[1].split() if described else fields
        named = dict(zip(names, values))
        kind = "warcinfo" if described else "response" if block.startswith(b"HTTP/") else "resource"
        yield {
            "offset": offset,
            "kind": kind,
            "uri": named.get("URL", ""),
            "ip": named.get("IP-address", "0.0.0.0"),
            "date": named.get("Archive-date", ""),
            "mime": named.get("Content-type", ""),
            "block": block,
        }
        if described and len(stated := block.decode("utf-8", "replace").split("\n")) > 1:
            fields = stated[1].split() or fields


def http_body(block: bytes) -> int:
    """Where the body of an HTTP message starts; its end if there is no blank line."""
    at = block.find(b"\r\n\r\n")
    return len(block) if at < 0 else at + 4


def http_field(head: bytes, name: bytes) -> bytes | None:
    for line in head.split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if colon and key.strip().lower() == name.lower():
            return value.strip()
    return None


def _number(value: bytes | None) -> int | None:
    try:
        return int(value) if value else None
    except ValueError:
        return None


_ARC = pa.schema(
    [
        ("record_id", pa.string()),
        ("kind", pa.string()),
        ("uri", pa.string()),
        ("ip", pa.string()),
        ("date", pa.string()),
        ("mime", pa.string()),
        ("page_id", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("block", pa.binary()),
    ]
)
_ARC_SQL = (
    "record_id string, kind string, uri string, ip string, date string, mime string, page_id long,"
    " payload_bytes long, payload_digest string"
)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def _records(files: DataFrame, parse, schema: pa.Schema, sql: str, blocks: bool) -> DataFrame:
    schema = schema if blocks else pa.schema([f for f in schema if f.name != "block"])

    def run(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for batch in batches(iterator):
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                with gzip.open(io.BytesIO(content.as_buffer())) as stream:
                    for record in parse(path, io.BufferedReader(stream)):
                        size += len(record["block"] or b"")
                        out.append(record if blocks else {k: v for k, v in record.items() if k != "block"})
                        if size > _FLUSH:
                            yield pa.RecordBatch.from_pylist(out, schema=schema)
                            out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return files.mapInArrow(run, sql + (", block binary" if blocks else ""))


def _arc_rows(path: str, stream: BinaryIO) -> Iterator[dict]:
    name = path.rsplit("/", 1)[-1]
    for record in parse_arc(stream):
        block = record["block"]
        body = http_body(block) if record["kind"] == "response" else 0
        identity = hashlib.sha256(f"{name}:{record['offset']}".encode()).digest()[:16]
        day = record.get("date", "")
        yield {
            "record_id": f"<urn:uuid:{uuid.UUID(bytes=identity, version=4)}>",
            "kind": record["kind"],
            "uri": record.get("uri", "").encode("utf-8", "replace").decode(),
            "ip": record.get("ip"),
            "date": f"{day[:4]}-{day[4:6]}-{day[6:8]}T{day[8:10]}:{day[10:12]}:{day[12:14]}Z" if len(day) == 14 and day.isdigit() else "1970-01-01T00:00:00Z",
            "mime": record.get("mime"),
            "page_id": _number(http_field(block[:body], PAGE_HEADER)) if record["kind"] == "response" else None,
            "payload_bytes": len(block) - body,
            "payload_digest": hashlib.sha256(memoryview(block)[body:]).hexdigest(),
            "block": block,
        }


def read_arc(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """Parsed records of all ARC files under ``path``, without their blocks if so asked."""
    return _records(_files(spark, path), _arc_rows, _ARC, _ARC_SQL, blocks)


# ---- WARC ----------------------------------------------------------------------------


def warc_record(row: dict) -> bytes:
    """A record without the two line ends that close it."""
    block, kind = row["block"], row["kind"]
    kept = row["first_id"] is None or row["first_id"] == row["record_id"]
    body = http_body(block) if kind == "response" else 0
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if not kept else 'metadata' if kind == 'damaged' else kind}",
        f"WARC-Record-ID: {row['record_id']}",
        f"WARC-Date: {row['date']}",
        f"WARC-Payload-Digest: sha256:{row['payload_digest']}",
    ]
    if kind in ("response", "resource"):
        lines += [f"WARC-Target-URI: {row['uri']}", f"WARC-IP-Address: {row['ip']}"]
    if not kept:
        block = block[:body]
        lines += [f"WARC-Refers-To: {row['first_id']}", f"WARC-Profile: {PROFILE}"]
    types = {"response": "application/http;msgtype=response", "warcinfo": "application/octet-stream"}
    lines += [
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"Content-Type: {types.get(kind, row['mime'] or 'application/octet-stream')}",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def convert(spark: SparkSession, arc: str, path: str, least: int = LEAST, records: int = FILE_RECORDS) -> None:
    """Write the ARC files under ``arc`` as WARC files under ``path``.

    HTTP responses with equal payloads of at least ``least`` bytes refer to the one with
    the smallest page id (then date and record id; records without a page id come last).
    The first of every repeated payload is found over ids and digests alone.
    """
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "date", "record_id")
    firsts = (
        read_arc(spark, arc, blocks=False)
        .where((F.col("kind") == "response") & (F.col("payload_bytes") >= least))
        .groupBy(F.col("payload_digest").alias("first_digest"))
        .agg(F.count("*").alias("copies"), F.min(order).alias("first"))
        .where("copies > 1")
        .select("first_digest", F.col("first.record_id").alias("first_id"))
    )
    firsts = stage(firsts, "warc-firsts")  # its size is known when the join is planned

    def run(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(iterator):
            built = [warc_record(row) for row in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(built, pa.binary())], names=["record"])

    rows = read_arc(spark, arc)
    joined = rows.join(
        firsts,
        (F.col("payload_digest") == F.col("first_digest"))
        & (F.col("kind") == "response")
        & (F.col("payload_bytes") >= least),
        "left",
    ).drop("first_digest")
    _write(joined.mapInArrow(run, "record binary"), path, "\r\n\r\n", records)


def parse_warc(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of every record, by declared lengths."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {stream.tell() - len(line)}")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, stream.read(int(fields["content-length"]))


_WARC = pa.schema(
    [
        ("record_id", pa.string()),
        ("record_type", pa.string()),
        ("uri", pa.string()),
        ("date", pa.string()),
        ("page_id", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("refers_to_id", pa.string()),
        ("block", pa.binary()),
    ]
)
_WARC_SQL = (
    "record_id string, record_type string, uri string, date string, page_id long,"
    " payload_bytes long, payload_digest string, refers_to_id string"
)


def _warc_rows(_: str, stream: BinaryIO) -> Iterator[dict]:
    for fields, block in parse_warc(stream):
        kind = fields["warc-type"]
        http = kind in ("response", "revisit")
        body = http_body(block) if http else 0
        stated = fields.get("warc-payload-digest", "").removeprefix("sha256:")
        yield {
            "record_id": fields["warc-record-id"],
            "record_type": kind,
            "uri": fields.get("warc-target-uri"),
            "date": fields.get("warc-date"),
            "page_id": _number(http_field(block[:body], PAGE_HEADER)) if http else None,
            # a revisit has no payload of its own: its HTTP header states the length
            "payload_bytes": _number(http_field(block[:body], b"Content-Length")) if kind == "revisit" else len(block) - body,
            "payload_digest": stated if kind == "revisit" else hashlib.sha256(memoryview(block)[body:]).hexdigest(),
            "refers_to_id": fields.get("warc-refers-to"),
            "block": block,
        }


def read_warc(spark: SparkSession, path: str, blocks: bool = False) -> DataFrame:
    """Records of all WARC files under ``path``; digests are computed from the payloads read."""
    return _records(_files(spark, path), _warc_rows, _WARC, _WARC_SQL, blocks)


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Pages as ARC archives of both versions, converted to WARC and read back.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to``, one row per page
    row, repeated rows and null ids included; no pages give no rows.
    """
    spark = pages.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/archives-{uuid.uuid4().hex}"
    page = F.col("page_id").cast("long")
    date = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.pmod(page, F.lit(31536000))), "yyyyMMddHHmmss")
    rows = pages.select(page.alias("page_id"), F.col("url").cast("string").alias("url"), date.alias("date"), "html")
    even = F.coalesce(page % 2 == 0, F.lit(True))
    write_arc(rows.where(even), f"{folder}/arc/v1", 1)
    write_arc(rows.where(~even), f"{folder}/arc/v2", 2)
    convert(spark, f"{folder}/arc/*", f"{folder}/warc", least)
    read = stage(read_warc(spark, f"{folder}/warc").where(F.col("record_type").isin("response", "revisit")), "warc-read")
    first = read.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to")
    )
    return read.join(first, "refers_to_id", "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
