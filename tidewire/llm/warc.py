"""Legacy archives to WARC.

An ARC file begins with a version block that names its version and the fields of
its header lines; each record is such a line and as many bytes as it declares.
The converter reads version 1 (URL, IP address, date, type, length) and version
2 (also result code, checksum, location, offset, file name), takes fields from
the right so that a URL may hold spaces, and synthesises for each record the
WARC identifier (a name-based UUID), the timestamp, the record type and the
SHA-256 digests of block and payload.

WARC files are written by Spark's text writer: the separator of lines is the
pair of line ends that closes a WARC record, so that each part file is a valid
archive, and they reach any store that Spark writes to.  They are read back as
whole files of bounded numbers of records.

Defined cases: a null payload is empty; a null URL becomes about:blank, and
white space in a URL is percent-encoded; a date that is no date becomes the
epoch; a declared length beyond the end of the file fails, as does a record
whose header line lacks fields; records with payloads under MIN_REVISIT bytes
are never revisits; rows that repeat a page_id with one payload are all
responses if that id is the smallest.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, fresh_dir, map_arrow, table

MIN_REVISIT = 100
#: Records in a WARC file at most; a reading task holds one file.
FILE_RECORDS = 4000
#: Header fields by ARC version, in order.
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    content_type: str
    block: bytes


def write_arc(records: list[ArcRecord], version: int, name: str = "pages.arc") -> bytes:
    """An ARC file of one version."""
    about = f"{version} 0 tidewire\n{' '.join(FIELDS[version])}\n".encode()
    head = f"filedesc://{name} 0.0.0.0 19700101000000 text/plain" + (" 200 - - 0 " + name if version == 2 else "")
    out = [f"{head} {len(about)}\n".encode(), about, b"\n"]
    at = sum(map(len, out))
    for r in records:
        url = "".join(f"%{ord(c):02X}" if c.isspace() and ord(c) < 128 else c for c in r.url) or "about:blank"
        extra = f" 200 {hashlib.md5(r.block).hexdigest()} - {at} {name}" if version == 2 else ""
        line = f"{url} {r.ip} {r.date} {r.content_type}{extra} {len(r.block)}\n".encode("utf-8", "surrogatepass")
        out += [line, r.block, b"\n"]
        at += len(line) + len(r.block) + 1
    return b"".join(out)


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file after its version block."""
    end = data.index(b"\n")
    first = data[:end].decode("utf-8", "surrogatepass")
    if not first.startswith("filedesc:"):
        raise ValueError("an ARC file begins with a filedesc record")
    size = int(first.rsplit(" ", 1)[1])
    about = data[end + 1 : end + 1 + size].decode("utf-8", "replace")
    version = int(about.split(" ", 1)[0])
    fields = about.split("\n")[1].split(" ")
    if tuple(fields) != FIELDS.get(version):
        raise ValueError(f"unknown ARC version or fields: {version} {fields}")
    at = end + 1 + size
    while True:
        while data[at : at + 1] == b"\n":
            at += 1
        if at >= len(data):
            return
        end = data.index(b"\n", at)
        values = data[at:end].decode("utf-8", "surrogatepass").rsplit(" ", len(fields) - 1)
        if len(values) < len(fields):
            raise ValueError("an ARC header line lacks fields")
        named = dict(zip(fields, values, strict=True))
        size = int(named["Archive-length"])
        block = data[end + 1 : end + 1 + size]
        if len(block) < size:
            raise ValueError("an ARC record is shorter than it declares")
        yield ArcRecord(named["URL"], named["IP-address"], named["Archive-date"], named["Content-type"], block)
        at = end + 1 + size


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """Head (with its empty line) and payload of a response; all is payload if it has no HTTP head."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    head, mark, payload = block.partition(b"\r\n\r\n")
    return head + mark, payload


def timestamp(date: str) -> str:
    """The WARC form of an ARC date of 14 digits (12 or 8 in early files)."""
    try:
        when = datetime.strptime(date.ljust(14, "0") if len(date) in (8, 12) else date, "%Y%m%d%H%M%S").replace(tzinfo=UTC)
    except ValueError:
        when = datetime.fromtimestamp(0, UTC)
    return when.strftime("%Y-%m-%dT%H:%M:%SZ")


def record_id(identity: str, payload_sha256: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{identity} {payload_sha256}')}>"


def to_warc(record: ArcRecord, identity: str | None = None, first: str | None = None, fields: dict[str, str] | None = None) -> bytes:
    """A WARC record without its closing line ends.

    identity: what sets the record's UUID, besides its payload; URL and date by default.  first: the identity of an
    earlier record of the same payload, which makes this one a revisit with no more than the HTTP head.
    """
    head, payload = http_parts(record.block)
    payload_sha256 = hashlib.sha256(payload).hexdigest()
    block = record.block if first is None else head
    is_http = bool(head)
    lines = {
        "WARC-Type": "revisit" if first is not None else "response" if is_http else "resource",
        "WARC-Record-ID": record_id(identity or f"{record.url} {record.date}", payload_sha256),
        "WARC-Date": timestamp(record.date),
        "WARC-Target-URI": record.url,
        "WARC-IP-Address": record.ip,
        "WARC-Payload-Digest": f"sha256:{payload_sha256}",
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type": "application/http;msgtype=response" if is_http else record.content_type,
        **(fields or {}),
    }
    if first is not None:
        lines |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(first, payload_sha256), "Payload-Length": str(len(payload))}
    lines["Content-Length"] = str(len(block))
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in lines.items()).encode("utf-8", "surrogatepass") + b"\r\n" + block


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of an uncompressed archive."""
    at = 0
    while at < len(data):
        if data[at : at + 7] != b"WARC/1.":
            raise ValueError(f"no WARC record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        fields = dict(line.split(": ", 1) for line in data[at:end].decode("utf-8", "surrogatepass").split("\r\n")[1:])
        size = int(fields["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) < size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"the WARC record at byte {at} is shorter than it declares")
        yield fields, block
        at = end + 8 + size


def convert(arcs: DataFrame, content_col: str = "content") -> DataFrame:
    """WARC records (record: string) of ARC files given whole, a row each."""

    def run(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in iterator:
            for data in batch.column(0).to_pylist():
                if data is not None:
                    records = [to_warc(r) for r in read_arc(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)]
                    yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], ["record"])

    return map_arrow(arcs.select(content_col), run, "record binary")


def write(records: DataFrame, path: str) -> None:
    """Write WARC records (record: string or binary) as compressed archives."""
    records.select(F.col("record").cast("string")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(fields: map, payload_bytes, payload_sha256) of every record in the archives of a folder."""

    def run(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in iterator:
            for data in batch.column(0).to_pylist():
                fields, sizes, digests = [], [], []
                for named, block in read_warc(gzip.decompress(data)):
                    if named["WARC-Type"] == "revisit":
                        sizes.append(int(named["Payload-Length"]))
                        digests.append(named["WARC-Payload-Digest"].removeprefix("sha256:"))
                    else:
                        payload = http_parts(block)[1]
                        sizes.append(len(payload))
                        digests.append(hashlib.sha256(payload).hexdigest())
                    fields.append(list(named.items()))
                yield pa.RecordBatch.from_arrays([pa.array(fields, pa.map_(pa.string(), pa.string())), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], ["fields", "payload_bytes", "payload_sha256"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return map_arrow(files.select("content"), run, "fields map<string,string>, payload_bytes long, payload_sha256 string")


def _arc_record(page_id: int | None, url: str | None, html: str | None) -> ArcRecord:
    """A page as a legacy capture; its id goes into the HTTP head."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    number = "" if page_id is None else str(page_id)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\nX-Page-Id: {number}\r\n\r\n"
    day = 20240101 + (page_id or 0) % 28
    return ArcRecord(url or "about:blank", "0.0.0.0", f"{day}000000", "text/html", head.encode() + payload)


def _page_of(block: bytes) -> str:
    return http_parts(block)[0].split(b"X-Page-Id: ", 1)[1].split(b"\r\n", 1)[0].decode()


def firsts(pages: DataFrame) -> DataFrame:
    """(page_id, first): pages whose payload of MIN_REVISIT bytes or more a page with a smaller id has, too."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    marks = pages.where("page_id IS NOT NULL").where(F.octet_length("html") >= MIN_REVISIT).select("page_id", F.sha2(payload, 256).alias("digest"))
    least = marks.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("digest", "first")
    return marks.join(least, "digest").where("page_id > first").select("page_id", "first", "digest").distinct()


def page_records(pages: DataFrame) -> DataFrame:
    """Pages as WARC records: written to ARC files in memory, of either version in turn, and converted."""
    later = firsts(pages).groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("digest", "first"))).alias("firsts"))

    def run(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version = 1
        for batch in batches(iterator, 4 << 20):
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "firsts")), strict=True))
            arc = write_arc([_arc_record(*r[:3]) for r in rows], version)
            version = 3 - version
            out = []
            for record, row in zip(read_arc(arc), rows, strict=True):
                first = None
                if row[3]:
                    digest = hashlib.sha256(http_parts(record.block)[1]).hexdigest()
                    first = dict(row[3]).get(digest)
                fields = {"Page-ID": _page_of(record.block)}
                if first is not None:
                    fields["Refers-To-Page-ID"] = str(first)
                out.append(to_warc(record, f"page {row[0]}", None if first is None else f"page {first}", fields))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    joined = pages.select("page_id", "url", "html").join(later, "page_id", "left")
    return map_arrow(joined.select("page_id", "url", "html", "firsts"), run, "record binary")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the pages as archives, read these back, and say what each record is."""
    path = fresh_dir(spark, "warc")
    write(page_records(table(spark, sf_dir, "pages")), path)
    back = read(spark, path)
    return back.select(
        F.expr("try_cast(fields['Page-ID'] AS BIGINT)").alias("page_id"), "payload_bytes", F.col("payload_sha256").alias("payload_digest"),
        F.col("fields")["WARC-Type"].alias("record_type"), F.expr("try_cast(fields['Refers-To-Page-ID'] AS BIGINT)").alias("refers_to"),
    )


OP1_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM f
"""
