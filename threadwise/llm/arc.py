"""Operator 9: a converter from legacy ARC archives to WARC.

An ARC file begins with a version block (``filedesc://``) whose second line names the version; version 1
has five fields in a record's header line, version 2 ten. The last field is the length of what follows. The
converter reads header line and declared length, never a delimiter, and makes the WARC record that
says the same: identifier (a UUID from the record's content), timestamp, type and digests. A file's version block
becomes its ``warcinfo`` record. Records with equal payloads become revisits of the one with the smallest id, whose
identifier, URI and date they name.

Payloads never cross the network between the steps: only (file, position, digest, ids, URL) is shuffled to find
equal payloads, and the revisits of a file go back to the task that converts it.

Defined cases: a null URL is ``-``; characters that a header line cannot hold are percent-encoded; a null or
empty payload is a payload of 0 bytes like any other; a null id is written without its header, is never
the smallest and is a response where all ids of the payload are null; rows with the smallest id are all
responses; an empty table gives no archive and no row; other columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadwise.llm.common import narrow_batches, partitions
from threadwise.llm.files import new_file, read_stream
from threadwise.session import reliable, shared_folder

ID_HEADER = "X-Page-Id"
REFERS_HEADER = "X-Refers-To-Page-Id"
LENGTH_HEADER = "X-Payload-Length"
CAPTURED = "20240101000000"
FILE_BYTES = 128 << 20
LEVEL = 1
# The field names of a record's header line by version, and WARC's profile of a revisit.
ARC_FIELDS = {
    "1": "URL IP-address Archive-date Content-type Archive-length",
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = pa.schema([("path", pa.string()), ("n_records", pa.int64())])
KEYS = pa.schema([("path", pa.string()), ("position", pa.int64()), ("page_id", pa.int64()), ("digest", pa.string()), ("n_bytes", pa.int64()), ("record_id", pa.string()), ("url", pa.string()), ("date", pa.string())])
RECORDS = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("date", pa.string()), ("url", pa.string()), ("page_id", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("refers_to_id", pa.string()), ("payload", pa.binary())])


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.string(): "string", pa.int64(): "long", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


class Members:
    """Writes each record as a gzip member of its own."""

    def __init__(self, out):
        self.out, self.size, self.records = out, 0, 0

    def add(self, *parts: bytes) -> None:
        squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        packed = b"".join([*map(squeeze.compress, parts), squeeze.flush()])
        self.out.write(packed)
        self.size += len(packed)
        self.records += 1


class Inflated(io.RawIOBase):
    """The plain bytes of a file of gzip members, as a stream."""

    def __init__(self, file):
        self.file, self.inflate, self.rest = file, zlib.decompressobj(31), b""

    def readable(self) -> bool:
        return True

    def readinto(self, target) -> int:
        while True:
            if self.inflate.eof:
                self.rest, self.inflate = self.inflate.unused_data or self.rest, zlib.decompressobj(31)
            data = self.rest or self.file.read(1 << 16)
            if not data:
                return 0
            plain = self.inflate.decompress(data, len(target))
            self.rest = self.inflate.unconsumed_tail
            if plain:
                target[: len(plain)] = plain
                return len(plain)


def open_members(path: str) -> io.BufferedReader:
    return io.BufferedReader(Inflated(read_stream(path)), 1 << 18)


# ---------------------------------------------------------------- ARC


def arc_version_block(version: str, name: str) -> bytes:
    body = f"{version} 0 threadwise\n{ARC_FIELDS[version]}\n".encode()
    fields = [f"filedesc://{name}", "0.0.0.0", CAPTURED, "text/plain"]
    if version == "2":
        fields += ["200", "-", "-", "0", name]
    return " ".join([*fields, str(len(body))]).encode() + b"\n" + body


def arc_header(version: str, url: str | None, mime: str, offset: int, name: str, length: int) -> bytes:
    safe = "!#$%&'()*+,/:;=?@[]~"
    fields = [quote(url, safe=safe, errors="replace") if url else "-", "0.0.0.0", CAPTURED, mime]
    if version == "2":
        fields += ["200", "-", "-", str(offset), name]
    return " ".join([*fields, str(length)]).encode() + b"\n"


def http_block(page_id: int | None, payload: bytes) -> bytes:
    own = f"{ID_HEADER}: {page_id}\r\n" if page_id is not None else ""
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def read_arc(stream, versions: list[tuple[str, bytes]] | None = None) -> Iterator[dict]:
    """Records of an ARC file: the fields of the header line by name, and ``block``. ``versions`` takes the name and
    the text of each version block that has been passed."""
    version = fields = None
    while line := stream.readline():
        if not line.strip():
            continue
        values = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        length = int(values[-1])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError("an ARC record is shorter than its declared length")
        if values[0].startswith("filedesc://"):
            first, names = block.decode("utf-8", "replace").split("\n")[:2]
            version, fields = first.split(" ")[0], names.split(" ")
            if ARC_FIELDS.get(version) != names:
                raise ValueError(f"unknown ARC version {first!r}")
            if versions is not None:
                versions.append((values[0].removeprefix("filedesc://"), block))
            continue
        if fields is None or len(values) != len(fields):
            raise ValueError("an ARC header line does not have its version's fields")
        yield dict(zip(fields, values)) | {"block": block, "version": version}


def _write_arcs(folder: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, done = TaskContext.get().partitionId(), 0
        rows = (r for b in narrow_batches(batches, "html") for r in zip(*(c.to_pylist() for c in b.columns)))
        row = next(rows, None)
        while row is not None:
            version, name = "12"[(part + done) % 2], f"pages-{part:06d}-{done:04d}.arc"
            with new_file(folder, name[:-4], ".arc.gz") as (out, uri):
                members = Members(out)
                members.add(arc_version_block(version, name), b"\n")
                while row is not None and members.size < file_bytes:
                    page_id, url, html = row
                    block = http_block(page_id, (html or "").encode("utf-8", "replace"))
                    members.add(arc_header(version, url, "text/html", members.size, name, len(block)), block, b"\n")
                    row = next(rows, None)
            yield _batch([(uri, members.records - 1)], MANIFEST)
            done += 1

    return run


def write_arc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write legacy archives, versions 1 and 2 in turn; gives their manifest (path, n_records)."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return reliable(rows.mapInArrow(_write_arcs(shared_folder(pages.sparkSession, "arc"), FILE_BYTES), _ddl(MANIFEST)))


# ---------------------------------------------------------------- WARC


def split_http(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(headers, head with its blank line, payload)."""
    head, _, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return dict(x.split(": ", 1) for x in lines if ": " in x), head + b"\r\n\r\n", payload


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _when(date: str) -> str:
    return f"{datetime.strptime(date, '%Y%m%d%H%M%S').replace(tzinfo=timezone.utc):%Y-%m-%dT%H:%M:%SZ}"


def record_id(*parts: str) -> str:
    """A UUID of what a record is made from, so that it can be named before it is written."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1('\n'.join(parts).encode()).digest()[:16], version=5)}>"


def warc_info(name: str, block: bytes) -> bytes:
    """The record that stands for an ARC file's version block."""
    fields = f"software: threadwise ARC converter\r\nformat: WARC File Format 1.1\r\nconverted-from: {name}\r\n".encode()
    made = fields + b"arc-version-block: " + b" ".join(block.split()) + b"\r\n"
    lines = [
        "WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {record_id(name, block.decode('utf-8', 'replace'))}", f"WARC-Date: {_when(CAPTURED)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(made)}", "Content-Type: application/warc-fields", f"Content-Length: {len(made)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + made + b"\r\n\r\n"


def warc_record(arc: dict, refers: tuple[int, str, str, str] | None) -> bytes:
    """The WARC record of an ARC record; a revisit holds the HTTP headers and no payload. ``refers``: page id, record
    id, URI and ARC date of the response that it revisits."""
    headers, head, payload = split_http(arc["block"])
    block = arc["block"] if refers is None else head
    digest = base32_sha1(payload)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(arc['URL'], arc['Archive-date'], headers.get(ID_HEADER, ''), digest)}",
        f"WARC-Date: {_when(arc['Archive-date'])}",
        f"WARC-Target-URI: {arc['URL']}",
        f"WARC-IP-Address: {arc['IP-address']}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        f"{LENGTH_HEADER}: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if ID_HEADER in headers:
        lines.append(f"{ID_HEADER}: {headers[ID_HEADER]}")
    if refers is not None:
        page_id, ident, url, date = refers
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {ident}", f"WARC-Refers-To-Target-URI: {url}", f"WARC-Refers-To-Date: {_when(date)}", f"{REFERS_HEADER}: {page_id}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_warc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, by declared length; the block's digest is checked."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            key, _, value = line.decode("utf-8", "replace").rstrip("\r\n").partition(": ")
            headers[key] = value
        block = stream.read(int(headers["Content-Length"]))
        if f"sha1:{base32_sha1(block)}" != headers["WARC-Block-Digest"] or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
        yield headers, block


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            rows = []
            with open_members(path) as stream:
                for i, arc in enumerate(read_arc(stream)):
                    headers, _, payload = split_http(arc["block"])
                    page_id = headers.get(ID_HEADER)
                    digest = base32_sha1(payload)
                    ident = record_id(arc["URL"], arc["Archive-date"], page_id or "", digest)
                    rows.append((path, i, int(page_id) if page_id else None, digest, len(payload), ident, arc["URL"], arc["Archive-date"]))
                    if len(rows) == 10_000:
                        yield _batch(rows, KEYS)
                        rows = []
            if rows:
                yield _batch(rows, KEYS)


def _convert(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, later in zip(*(c.to_pylist() for c in batch.columns)):
                revisits = {x["position"]: (x["page_id"], x["record_id"], x["url"], x["date"]) for x in later or []}
                with open_members(path) as stream, new_file(folder, "pages", ".warc.gz") as (out, uri):
                    members, versions, told = Members(out), [], 0
                    for i, arc in enumerate(read_arc(stream, versions)):
                        for name, block in versions[told:]:
                            members.add(warc_info(name, block))
                        told = len(versions)
                        members.add(warc_record(arc, revisits.get(i)))
                    members.records -= told
                yield _batch([(uri, members.records)], MANIFEST)

    return run


def convert(arcs: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Convert the archives of a manifest; gives the manifest of the WARC files."""
    spark = arcs.sparkSession
    files = arcs.select("path").repartition(partitions(spark))
    keys = reliable(files.mapInArrow(_digests, _ddl(KEYS)))
    same = ["digest", "n_bytes"]
    named = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "record_id", "url", "date"))
    first = keys.where(F.col("n_bytes") >= min_revisit_bytes).groupBy(*same).agg(F.min(named).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL")
    first = reliable(first)
    later = keys.join(first, same).where("page_id IS NULL OR page_id > first.page_id")
    lists = later.groupBy("path").agg(F.collect_list(F.struct("position", "first.page_id", "first.record_id", "first.url", "first.date")).alias("later"))  # records of one file at most
    jobs = arcs.select("path").join(lists, "path", "left").select("path", "later").repartition(partitions(spark))
    return reliable(jobs.mapInArrow(_convert(shared_folder(spark, "warc")), _ddl(MANIFEST)))


def _records(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                with open_members(path) as stream:
                    for h, block in read_warc(stream):
                        if h["WARC-Type"] == "warcinfo":
                            continue
                        number = lambda k: int(h[k]) if k in h else None
                        payload = split_http(block)[2] if with_payload and h["WARC-Type"] == "response" else None
                        rows.append((h["WARC-Record-ID"], h["WARC-Type"], h["WARC-Date"], h["WARC-Target-URI"], number(ID_HEADER), h["WARC-Payload-Digest"].removeprefix("sha1:"), number(LENGTH_HEADER), number(REFERS_HEADER), h.get("WARC-Refers-To"), payload))
                        size += len(payload or b"") + 200
                        if size > 4 << 20:
                            yield _batch(rows, RECORDS)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows, RECORDS)

    return run


def read_records(spark: SparkSession, warcs: DataFrame, with_payload: bool = True) -> DataFrame:
    return warcs.select("path").repartition(partitions(spark)).mapInArrow(_records(with_payload), _ddl(RECORDS))
