"""Legacy ARC archives to WARC: parse, convert, write, read back.

An ARC file starts with a version block whose first line, as those of all records, ends with the
declared length of what follows. Version 1 lines have five fields, version 2 lines ten. A converted
record gets a WARC identifier made from its content and place, an ISO date, a type and digests.

Archives have a gzip member for each record. They are written by Spark's own writer and so are committed
like any table: a lost executor or a second attempt leaves no half file (file names are Spark's). They
are read as whole files by Spark, so any file system that Spark knows will do; a file has records of
less than 1 MB, 1000 at most, or one larger record alone.

Defined results: a null payload is an empty one; a null url is written as "-"; white space and
control characters in urls are percent-encoded; a null page_id stays null; payloads of any length that
a row can hold are written whole; of rows that repeat a page_id and payload, all with the smallest
page_id are responses; other columns, whatever their names, are not looked at; an empty table makes no
record.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, stash

# The fields of the header lines of the two ARC versions.
FIELDS = {
    1: ("url", "ip-address", "archive-date", "content-type", "archive-length"),
    2: ("url", "ip-address", "archive-date", "content-type", "result-code", "checksum", "location", "offset", "filename", "archive-length"),
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_REVISIT_BYTES = 100
RECORDS_PER_FILE = 1000
LARGE_BYTES = 1 << 20
MEMBER_BYTES = 8 << 20  # a gzip member says its length in four bytes; under 16 MB the last is 0
RECORD_END = b"\r\n\r\n"
_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:metricloom:arc")


class ArcError(ValueError):
    """A header line or a declared length that does not fit the file."""


@dataclass(frozen=True)
class ArcRecord:
    version: int
    fields: dict[str, str]
    content: bytes
    offset: int

    @property
    def is_version_block(self) -> bool:
        return self.fields["url"].startswith("filedesc:")


@dataclass
class WarcRecord:
    headers: dict[str, str]
    block: bytes
    fields: dict[str, str] = field(default_factory=dict)

    def to_bytes(self) -> bytes:
        """The record without the two line ends that close it."""
        head = "".join([f"{k}: {v}\r\n" for k, v in self.headers.items()])
        return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + self.block

    @property
    def payload(self) -> bytes:
        return http_payload(self.block) if self.headers.get("Content-Type", "").startswith("application/http") else self.block


def http_payload(block: bytes) -> bytes:
    head, end, body = block.partition(b"\r\n\r\n")
    return body if end else b""


def http_headers(block: bytes) -> dict[str, str]:
    lines = block.partition(b"\r\n\r\n")[0].decode("latin-1").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def arc_version(stream: BinaryIO) -> tuple[int, ArcRecord]:
    """Read the version block at the start: its lines say which fields all later header lines have."""
    line = stream.readline()
    values = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
    if not values[0].startswith("filedesc:") or not values[-1].isdigit():
        raise ArcError(f"no version block: {line[:80]!r}")
    content = stream.read(int(values[-1]))
    first = content.split(b"\n", 1)[0].split(b" ")
    version = int(first[0]) if first[0].isdigit() else 0
    if version not in FIELDS:
        raise ArcError(f"unknown ARC version {first[0]!r}")
    if len(values) != len(FIELDS[version]):
        raise ArcError(f"version {version} lines have {len(FIELDS[version])} fields, not {len(values)}")
    return version, ArcRecord(version, dict(zip(FIELDS[version], values, strict=True)), content, 0)


def read_arc(stream: BinaryIO) -> Iterator[ArcRecord]:
    """All records of an ARC file, the version block first."""
    version, record = arc_version(stream)
    yield record
    names = FIELDS[version]
    while True:
        offset = stream.tell()
        line = stream.readline()
        while line in (b"\n", b"\r\n"):
            offset = stream.tell()
            line = stream.readline()
        if not line:
            return
        values = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        if len(values) < len(names) or not values[-1].isdigit():
            raise ArcError(f"bad header line at {offset}: {line[:80]!r}")
        # a type may hold spaces ("text/html; charset=x"); the fields on both sides of it don't
        extra = len(values) - len(names)
        values = [*values[:3], " ".join(values[3:4 + extra]), *values[4 + extra:]]
        length = int(values[-1])
        content = stream.read(length)
        if len(content) != length:
            raise ArcError(f"record at {offset} declares {length} bytes, {len(content)} are left")
        yield ArcRecord(version, dict(zip(names, values, strict=True)), content, offset)


def write_arc(version: int, name: str, date: str, records: list[tuple[str, str, str, bytes]]) -> bytes:
    """An ARC file of (url, date, type, content) records."""
    body = f"{version} 0 metricloom\n{' '.join(FIELDS[version])}\n\n".encode()
    out = io.BytesIO()

    def put(url: str, when: str, kind: str, content: bytes) -> None:
        if version == 1:
            values = [url, "0.0.0.0", when, kind, str(len(content))]
        else:
            values = [url, "0.0.0.0", when, kind, "200", "-", "-", str(out.tell()), name, str(len(content))]
        out.write(" ".join(values).encode() + b"\n" + content + b"\n")

    put(f"filedesc://{name}", date, "text/plain", body)
    for r in records:
        put(*r)
    return out.getvalue()


def clean_url(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "-"


def iso_date(date: str) -> str:
    """14 digits (or fewer: the rest is the start of the period) as a WARC date."""
    if not date.isdigit() or len(date) < 4:
        return "1970-01-01T00:00:00Z"
    full = date[:14] + "00000101000000"[min(14, len(date)):]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, chr(0).join(parts))}>"


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def convert(record: ArcRecord, extra: dict[str, str] | None = None, identity: str | None = None, revisits: str | None = None) -> WarcRecord:
    """The WARC equivalent of an ARC record.

    ``identity`` names the record where the caller has a name that stays the same in every run; else
    url, date, offset and digest do. ``revisits`` is the identity of the record with the same payload:
    then the block ends after the HTTP headers.
    """
    url, date = record.fields["url"], record.fields["archive-date"]
    block, kind = record.content, record.fields["content-type"]
    http = block[:5] == b"HTTP/"
    if record.is_version_block:
        kind_of, kind = "warcinfo", "application/warc-fields"
        block = f"software: metricloom\r\nformat: WARC File Format 1.1\r\nconverted-from: ARC {record.version}\r\n".encode()
        payload = block
    elif http:
        kind_of, kind, payload = "response", "application/http; msgtype=response", http_payload(block)
    elif url.startswith("dns:"):
        kind_of, kind, payload = "resource", "text/dns", block
    else:
        kind_of, payload = "resource", block
    digest = sha256(payload)
    head = {"WARC-Type": kind_of, "WARC-Record-ID": record_id(identity) if identity is not None else record_id(url, date, str(record.offset), digest), "WARC-Date": iso_date(date)}
    if kind_of != "warcinfo":
        head["WARC-Target-URI"] = url
        if record.fields["ip-address"] not in ("-", "0.0.0.0"):
            head["WARC-IP-Address"] = record.fields["ip-address"]
        head["WARC-Payload-Digest"] = f"sha256:{digest}"
    if revisits is not None and http:
        head |= {"WARC-Type": "revisit", "WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": record_id(revisits)}
        block = block[:len(block) - len(payload)]
    head |= {"WARC-Block-Digest": f"sha256:{sha256(block)}"} | (extra or {}) | {"Content-Type": kind, "Content-Length": str(len(block))}
    return WarcRecord(head, block)


def read_warc(stream: BinaryIO) -> Iterator[WarcRecord]:
    """All records of a WARC file, by their declared lengths."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:60]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip()] = value.strip()
        length = int(head["Content-Length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError(f"a record declares {length} bytes, {len(block)} are left")
        yield WarcRecord(head, block)


def members(record: bytes) -> bytes:
    """A record with its end as one gzip member (several if it is very long)."""
    whole = record + RECORD_END
    out = []
    for lo in range(0, len(whole), MEMBER_BYTES):
        z = zlib.compressobj(4, zlib.DEFLATED, 31)
        out += [z.compress(whole[lo:lo + MEMBER_BYTES]), z.flush()]
    return b"".join(out)


# ---- Spark ----

def revisit_groups(pages: DataFrame, payload: str = "html") -> DataFrame:
    """digest, refers_to: the smallest page_id of each payload of 100 bytes or more that several rows have."""
    text = F.coalesce(F.col(payload), F.lit(""))
    return (
        pages.select("page_id", F.sha2(text, 256).alias("digest"), F.octet_length(text).alias("size"))
        .where(F.col("size") >= MIN_REVISIT_BYTES)
        .groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").select("digest", "refers_to")
    )


def to_records(pages: DataFrame, date: str = "20200101000000", version: int | None = None) -> DataFrame:
    """One gzipped WARC record (column ``record``, binary) per row of page_id, url, html, refers_to.

    The rows of a batch become an ARC file in memory (version 1 and 2 in turn, or the one asked for),
    and that file goes through the parser and the converter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for part in slices(batches, 2):
            for lo in range(0, part.num_rows, 500):
                rows = part.slice(lo, 500).to_pylist()
                number = version or 1 + turn % 2
                turn += 1
                made = []
                for r in rows:
                    body = (r["html"] or "").encode()
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n"
                    made.append((clean_url(r["url"]), date, "text/html", head.encode() + body))
                archive = read_arc(io.BytesIO(write_arc(number, f"part-{turn}.arc", date, made)))
                out = [members(convert(next(archive)).to_bytes())]
                for r, record in zip(rows, archive, strict=True):
                    page, refers = r["page_id"], r["refers_to"]
                    refers = None if refers is None or refers == page else refers
                    extra = {} if page is None else {"X-Page-Id": str(page)}
                    if refers is not None:
                        extra["X-Refers-To-Page-Id"] = str(refers)
                    out.append(members(convert(record, extra, None if page is None else f"page:{page}", None if refers is None else f"page:{refers}").to_bytes()))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    return pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, "record binary")


def write_archives(records: DataFrame, path: str, per_file: int = RECORDS_PER_FILE) -> None:
    """Write gzipped records as WARC files of at most ``per_file`` records.

    Spark's writer ends each value with a separator: here the last byte of the gzip member, which is 0.
    """
    value = F.expr("substring(record, 1, length(record) - 1)").cast("string")
    records.select(value.alias("value")).write.mode("append").option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", per_file).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url and record_id of the records below ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("record_id", pa.string())])
        for batch in batches:
            for content in batch.column(0):
                data = content.as_buffer()
                stream = pa.BufferReader(data)
                raw = gzip.GzipFile(fileobj=stream) if data.slice(0, 2).to_pybytes() == b"\x1f\x8b" else stream
                rows: list[dict] = []
                for r in read_warc(io.BufferedReader(raw, 1 << 16)):
                    h = r.headers
                    if h["WARC-Type"] == "warcinfo":
                        continue
                    if h["WARC-Type"] == "revisit":  # the payload is in the record referred to; its headers are here
                        size, digest = int(http_headers(r.block)["content-length"]), h["WARC-Payload-Digest"].removeprefix("sha256:")
                    else:
                        payload = r.payload
                        size, digest = len(payload), sha256(payload)
                        if h["WARC-Payload-Digest"] != f"sha256:{digest}":
                            raise ValueError(f"{h['WARC-Record-ID']}: the payload does not have the digest declared")
                    number = lambda k, h=h: int(h[k]) if k in h else None
                    rows.append({"page_id": number("X-Page-Id"), "payload_bytes": size, "payload_digest": digest, "record_type": h["WARC-Type"], "refers_to": number("X-Refers-To-Page-Id"), "url": h["WARC-Target-URI"], "record_id": h["WARC-Record-ID"]})
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, record_id string")


def archive(pages: DataFrame, path: str) -> DataFrame:
    """Write every row of ``pages`` to WARC files below ``path`` and return what they hold when read again."""
    spark = pages.sparkSession
    pages = pages.select("page_id", "url", "html")
    groups = stash(revisit_groups(pages), "payloads")
    text = F.coalesce(F.col("html"), F.lit(""))
    size = F.octet_length(text)
    # payloads that are never revisited have a key of their own each, so that empty ones are no hot key
    key = F.when(size >= MIN_REVISIT_BYTES, F.sha2(text, 256)).otherwise(F.concat(F.lit("small "), F.hash("page_id", "url").cast("string")))
    keyed = pages.withColumn("digest", key).withColumn("large", size >= LARGE_BYTES)
    if groups.isEmpty():
        marked = keyed.withColumn("refers_to", F.lit(None).cast("bigint"))
    else:  # groups are a written table with a row for each payload, so Spark can split a payload that many rows share
        marked = keyed.join(groups, "digest", "left")
    write_archives(to_records(marked.where("NOT large")), path)
    if not keyed.where("large").isEmpty():
        write_archives(to_records(marked.where("large")), path, 1)
    return read_archives(spark, path)
