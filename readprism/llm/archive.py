"""Legacy web archives: ARC files in, WARC files out, and a reader of both.

An ARC file holds records of one header line and as many bytes as that line
declares, each followed by a line feed. The first record of a file, the version
block, says which version's header lines follow:

* version 1: ``URL IP-address Archive-date Content-type Archive-length``
* version 2: ``URL IP-address Archive-date Content-type Result-code Checksum
  Location Offset Filename Archive-length``

The converter parses those lines, cuts blocks by their declared lengths, and
makes a WARC record for each: record id (a UUID of the record's header, payload
and place in its file), date (ISO 8601 from 14 digits), type (``response`` for an HTTP block,
``resource`` for any other), block and payload digests. Records whose payload
another record already carries become ``revisit`` records: they keep the HTTP
header, refer to that record, and leave the payload out.

Files are written and read by Spark's own text and binary sources (the text
source's line separator is what ends a record in either format), so any store
that Spark reaches will do, commits are atomic and lost tasks run again.

Defined results: a null payload is empty. A null id stays null (the id header is
left out); ids need not be unique: with equal ids and payloads, the row that comes
last in the archive is the response. White space in a url is percent-encoded; a null url is ``-``. Empty
tables give empty archives and results; further columns are ignored. Payloads are
read and written whole, a file at a time. A truncated or malformed header raises
``ValueError`` with the file's name and the offset.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readprism.llm.shared import scratch_path

MIN_REVISIT_BYTES = 1000
FILE_BYTES = 16 << 20
#: Hadoop's name of the gzip level: HTML takes two fifths of the default level's time and 4 % more room.
GZIP_LEVEL = "FOUR"
BROADCAST_BYTES = 32 << 20
ARC_FIELDS = {
    b"1": b"URL IP-address Archive-date Content-type Archive-length",
    b"2": b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
ID_HEADER, REFERS_HEADER, LENGTH_HEADER = "X-Source-Id", "X-Refers-To-Source-Id", "X-Payload-Length"
_NAMESPACE = uuid.UUID("8f0f3c0e-6c1b-5f43-9f0a-2f1f5a1b7a11")


@dataclass(frozen=True)
class Record:
    """One archived capture, from either format."""

    url: str
    date: str
    mime: str
    ip: str
    block: bytes
    at: int


# --- ARC -------------------------------------------------------------------


def inflate(data: bytes) -> bytes:
    """The content of concatenated gzip members; other bytes as they are."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        one = zlib.decompressobj(31)
        out.append(one.decompress(data) + one.flush())
        if not one.eof:
            raise ValueError("truncated gzip member")
        data = one.unused_data
    return b"".join(out)


def arc_records(data: bytes, name: str = "") -> Iterator[Record]:
    """The captures of an ARC file of either version; version blocks only set the fields that follow."""
    at, fields = 0, []
    while at < len(data):
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].rstrip(b"\r")
        if not line:
            at = end + 1 if end >= 0 else len(data)
            continue
        parts = line.split(b" ")
        first = line.startswith(b"filedesc://")
        if not parts[-1].isdigit() or end < 0 or (not first and len(parts) != len(fields)):
            raise ValueError(f"{name}: no ARC header line at byte {at}")
        start, size = end + 1, int(parts[-1])
        block = data[start : start + size]
        if len(block) < size:
            raise ValueError(f"{name}: record at byte {at} is cut off")
        here, at = at, start + size
        if first:
            lines = block.split(b"\n")
            version = lines[0].split(b" ")[0]
            if version not in ARC_FIELDS:
                raise ValueError(f"{name}: ARC version {version!r} is unknown")
            fields = (lines[1].strip() if len(lines) > 1 and lines[1].strip() else ARC_FIELDS[version]).decode("utf-8", "replace").split(" ")
            if missing := {"URL", "Archive-date", "Content-type", "IP-address"} - set(fields):
                raise ValueError(f"{name}: the version block has no {', '.join(sorted(missing))}")
            continue
        of = dict(zip(fields, (p.decode("utf-8", "replace") for p in parts)))
        yield Record(of["URL"], of["Archive-date"], of["Content-type"], of["IP-address"], block, here)


def _safe_url(url: Column) -> Column:
    for char, code in ((" ", "%20"), ("\t", "%09"), ("\n", "%0A"), ("\r", "%0D"), ("\x0b", "%0B"), ("\x0c", "%0C")):
        url = F.replace(url, F.lit(char), F.lit(code))
    return F.when(F.length(url) > 0, url).otherwise(F.lit("-"))


def _bytes(column: Column) -> Column:
    return F.octet_length(column)


def write_arc(pages: DataFrame, path: str, *, version: int = 1, file_records: int = 4096, captured: str = "20260101000000", ip: str = "192.0.2.1") -> None:
    """Write rows (id, url, payload) as ARC files of up to ``file_records`` HTTP captures.

    The id travels as an HTTP header of the capture. Every file starts with a
    version block; no row is shuffled.
    """
    fields = ARC_FIELDS[str(version).encode()].decode()
    body = f"{version} 0 readprism\n{fields}\n"
    tail = "200 - - 0 legacy.arc " if version == 2 else ""
    intro = f"filedesc://legacy.arc 0.0.0.0 {captured} text/plain {tail}{len(body)}\n{body}"
    payload = F.coalesce(F.col("payload"), F.lit(""))
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) % file_records == 0  # of its task's rows, so of its file's
    key = F.coalesce(F.concat(F.lit(f"{ID_HEADER}: "), F.col("id").cast("string"), F.lit("\r\n")), F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), key, F.lit("Content-Length: "), _bytes(payload).cast("string"), F.lit("\r\n\r\n"))
    size = _bytes(head) + _bytes(payload)
    line = F.concat(_safe_url(F.col("url")), F.lit(f" {ip} {captured} text/html {tail}"), size.cast("string"), F.lit("\n"))
    record = pages.select(F.concat(F.when(first, F.lit(intro + "\n")).otherwise(F.lit("")), line, head, payload).alias("record"))
    _write_text(record, path, "\n", file_records)


def _write_text(records: DataFrame, path: str, end: str, file_records: int) -> None:
    records.write.option("lineSep", end).option("compression", "gzip").option("zlib.compress.level", GZIP_LEVEL).option("maxRecordsPerFile", file_records).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")


def _http(block: bytes) -> tuple[bytes, bytes]:
    """(header with its blank line, payload) of an HTTP block; no header for any other block."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    end = block.find(b"\r\n\r\n")
    return (block, b"") if end < 0 else (block[: end + 4], block[end + 4 :])


def _fields(head: bytes) -> dict[bytes, bytes]:
    """The fields of a header by lower-case name, the first of each."""
    found: dict[bytes, bytes] = {}
    for line in head.split(b"\n"):
        name, colon, value = line.partition(b":")
        if colon:
            found.setdefault(name.lower(), value.lstrip(b" \t").partition(b"\r")[0])
    return found


def _field(fields: dict[bytes, bytes], name: str) -> str | None:
    found = fields.get(name.lower().encode())
    return None if found is None else found.decode()


def _number(text: str | None) -> int | None:
    """A number of up to 18 digits; other archives may have other values under the same name."""
    return int(text) if text is not None and re.fullmatch(r"-?\d{1,18}", text) else None


_CAPTURES = pa.schema([("id", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("mime", pa.string()), ("ip", pa.string()), ("place", pa.string()), ("head", pa.binary()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("digest", pa.binary())])
_CAPTURES_DDL = "id long, url string, date string, mime string, ip string, place string, head binary, payload binary, payload_bytes long, digest binary"


def _batches(rows: Iterator[dict], schema: pa.Schema, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches of about ``limit`` bytes of binary values."""
    held: list[dict] = []
    size = 0
    for row in rows:
        held.append(row)
        size += 200 + sum(len(v) for v in row.values() if type(v) is bytes)
        if size >= limit:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _captures(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The captures of files (path, content), as rows of ``_CAPTURES``."""
    for batch in batches:
        for name, content in zip(batch.column("path"), batch.column("content")):
            path = name.as_py()
            for r in arc_records(inflate(content.as_py()), path):
                head, payload = _http(r.block)
                yield {"id": _number(_field(_fields(head), ID_HEADER)), "url": r.url, "date": r.date, "mime": r.mime, "ip": r.ip, "place": f"{path.rpartition('/')[2]}:{r.at:012d}", "head": head, "payload": payload, "payload_bytes": len(payload), "digest": hashlib.sha1(payload).digest()}


def read_arc(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """The captures of ARC files; without ``payloads`` only their lengths and digests leave the reader."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _captures(batches)
        yield from _batches(rows if payloads else (r | {"payload": None} for r in rows), _CAPTURES)

    return _files(spark, path).mapInArrow(parse, _CAPTURES_DDL)


# --- WARC ------------------------------------------------------------------


def _sha1(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


_RECORDS = pa.schema([("digest", pa.binary()), ("place", pa.string()), ("record", pa.binary()), ("revisit", pa.binary()), ("head", pa.binary())])
_RECORDS_DDL = "digest binary, place string, record binary, revisit binary, head binary"


def record_id(url: str, date: str, key: int | None, digest: bytes, place: str) -> str:
    """A URN of the capture and its place (file and offset) in the archive: converting again gives the same, repeated captures differ."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{url} {date} {key} {digest.hex()} {place}')}>"


def _shared_lines(row: dict) -> tuple[str, str, str]:
    """The header lines that a capture's record and its revisit share: before the block's digest, up to its length, after it."""
    parts = re.match(r"(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)", row["date"].ljust(14, "0"))
    if not parts:
        raise ValueError(f"{row['place']}: no ARC date: {row['date']!r}")
    date = "{}-{}-{}T{}:{}:{}Z".format(*parts.groups())
    before = f"WARC-Record-ID: {record_id(row['url'], row['date'], row['id'], row['digest'], row['place'])}\r\nWARC-Date: {date}\r\nWARC-Target-URI: {row['url']}\r\nWARC-IP-Address: {row['ip']}\r\n"
    between = f"WARC-Payload-Digest: {_sha1(row['digest'])}\r\nContent-Type: {'application/http; msgtype=response' if row['head'] else row['mime']}\r\n"
    after = f"{LENGTH_HEADER}: {len(row['payload'])}\r\n" + (f"{ID_HEADER}: {row['id']}\r\n" if row["id"] is not None else "")
    return before, between, after


def _warc_head(kind: str, shared: tuple[str, str, str], block: bytes) -> bytes:
    """The header of a record of this kind and block; its blank line isn't there yet."""
    before, between, after = shared
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\n{before}WARC-Block-Digest: {_sha1(hashlib.sha1(block).digest())}\r\n{between}Content-Length: {len(block)}\r\n{after}".encode()


def warc_record(row: dict, shared: tuple[str, str, str] | None = None) -> bytes:
    """A WARC/1.1 record of a capture with its payload, without the two line ends that close it (the text writer adds them)."""
    block = row["head"] + row["payload"]
    return _warc_head("response" if row["head"] else "resource", shared or _shared_lines(row), block) + b"\r\n" + block


def revisit_head(row: dict, shared: tuple[str, str, str] | None = None) -> bytes:
    """The header of the same capture's revisit, up to the lines that name the record it refers to."""
    return _warc_head("revisit", shared or _shared_lines(row), row["head"]) + b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"


def revisit_groups(captures: DataFrame) -> DataFrame:
    """(digest, id, url and record id of the record to keep, its place) for payloads of at least ``MIN_REVISIT_BYTES`` that occur again.

    The aggregate is combined before the shuffle: a payload that a third of all
    rows share is one row of each task.
    """
    best = F.max(F.struct(F.col("id").isNotNull().alias("known"), "id", "url", "date", "place"))
    groups = captures.where(F.col("payload_bytes") >= MIN_REVISIT_BYTES).groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("n"))
    named = F.udf(lambda *of: record_id(*of), "string")("best.url", "best.date", "best.id", "digest", "best.place")
    return groups.where("n > 1").select("digest", F.col("best.id").alias("refer_id"), F.col("best.url").alias("refer_url"), named.alias("refer_record"), F.col("best.place").alias("refer_place"))


def convert_arc(spark: SparkSession, arc_path: str, warc_path: str, *, file_records: int = 4096) -> None:
    """Convert ARC files to gzipped WARC files of about the same number.

    A first pass over the files finds repeated payloads by their digests; the
    second makes the record of each capture, and the header of its revisit if the
    payload is long enough, and that table decides by digest which is written. The table
    is broadcast if it is measured to be at most ``BROADCAST_BYTES``, otherwise both sides
    are shuffled, where AQE splits the partition of a very common payload.
    """
    path = scratch_path(spark, "revisits")
    revisit_groups(read_arc(spark, arc_path, payloads=False)).write.parquet(path)
    groups = spark.read.schema("digest binary, refer_id long, refer_url string, refer_record string, refer_place string").parquet(path)
    size = groups.agg(F.sum(F.lit(150) + F.length("refer_url"))).first()[0] or 0

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for r in _captures(batches):
                shared = _shared_lines(r)
                again = {"revisit": revisit_head(r, shared), "head": r["head"]} if r["payload_bytes"] >= MIN_REVISIT_BYTES else {}
                yield {"digest": r["digest"], "place": r["place"], "record": warc_record(r, shared)} | again

        yield from _batches(rows(), _RECORDS)

    records = _files(spark, arc_path).mapInArrow(build, _RECORDS_DDL)
    joined = records.join(F.broadcast(groups) if size <= BROADCAST_BYTES else groups, "digest", "left")
    key = F.coalesce(F.concat(F.lit(f"{REFERS_HEADER}: "), F.col("refer_id").cast("string"), F.lit("\r\n")), F.lit(""))
    refers = F.concat(F.lit("WARC-Refers-To: "), "refer_record", F.lit("\r\nWARC-Refers-To-Target-URI: "), "refer_url", F.lit("\r\n"), key, F.lit("\r\n"))
    revisit = F.concat("revisit", refers.cast("binary"), "head")
    written = F.when(F.col("place") != F.col("refer_place"), revisit).otherwise(F.col("record"))
    _write_text(joined.select(written.cast("string").alias("record")), warc_path, "\r\n\r\n", file_records)


def warc_records(data: bytes, name: str = "") -> Iterator[tuple[bytes, bytes]]:
    """(header, block) of each record of a WARC file."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        head = data[at:end]
        size = _field(_fields(head), "Content-Length")
        if end < 0 or not head.startswith(b"WARC/") or size is None:
            raise ValueError(f"{name}: no WARC header at byte {at}")
        start = end + 4
        block = data[start : start + int(size)]
        at = start + int(size)
        if len(block) < int(size) or data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"{name}: record at byte {start} is cut off")
        at += 4
        yield head, block


_WARC = pa.schema([("id", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("date", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("refers_to_record", pa.string()), ("payload", pa.binary())])
_WARC_DDL = "id long, record_id string, record_type string, url string, date string, payload_bytes long, payload_digest string, refers_to long, refers_to_record string, payload binary"


def read_warc(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """The records of WARC files.

    Length and digest of a stored payload are measured again and held against
    the header; those of a revisit come from its WARC header, and its length is
    null where that doesn't state it.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                for name, content in zip(batch.column("path"), batch.column("content")):
                    for head, block in warc_records(inflate(content.as_py()), name.as_py()):
                        fields, http = _fields(head), _http(block)
                        kind = _field(fields, "WARC-Type")
                        claimed = base64.b32decode(_field(fields, "WARC-Payload-Digest").removeprefix("sha1:"))
                        digest = claimed if kind == "revisit" else hashlib.sha1(http[1]).digest()
                        if digest != claimed:
                            raise ValueError(f"{name}: payload digest of {_field(fields, 'WARC-Record-ID')} differs")
                        yield {
                            "id": _number(_field(fields, ID_HEADER)), "record_id": _field(fields, "WARC-Record-ID"), "record_type": kind, "url": _field(fields, "WARC-Target-URI"), "date": _field(fields, "WARC-Date"),
                            "payload_bytes": _number(_field(fields, LENGTH_HEADER)) if kind == "revisit" else len(http[1]), "payload_digest": digest.hex(),
                            "refers_to": _number(_field(fields, REFERS_HEADER)), "refers_to_record": _field(fields, "WARC-Refers-To"), "payload": http[1] if payloads and kind != "revisit" else None,
                        }

        yield from _batches(rows(), _WARC)

    return _files(spark, path).mapInArrow(parse, _WARC_DDL)


def archive_round_trip(pages: DataFrame, *, version: int = 1) -> DataFrame:
    """Write rows (id, url, payload) as ARC, convert them to WARC and read that back.

    Files take as many records as make ``FILE_BYTES`` on average.
    """
    spark = pages.sparkSession
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    mean = pages.agg(F.avg(F.coalesce(_bytes(F.col("payload")), F.lit(0)) + 300)).first()[0] or 1
    file_records = max(1, int(FILE_BYTES / mean))
    write_arc(pages, arc, version=version, file_records=file_records)
    convert_arc(spark, arc, warc, file_records=file_records)
    return read_warc(spark, warc, payloads=False)
