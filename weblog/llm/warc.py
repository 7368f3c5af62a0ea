"""WARC records in ZIP archives: writing, and reading by the archives' own directories.

An archive is a ZIP file with two stored (uncompressed) members: ``archive/data.warc`` and
``indexes/index.cdxj``, one JSON line per record with its place in the WARC member. Sizes and offsets
stand in ZIP64 fields and the end of the directory has its ZIP64 form, so members may pass 4 GB.

Archives are written by Spark's text writer, one row and file per archive, so they
land in any file system Spark writes to, under its commit protocol. The line feed that the writer puts behind a row
is declared as the archive's comment, so the file is a valid ZIP archive.

``read`` parses the end of central directory (ZIP64 form included), the central directory and the
members' local headers, takes the index, and cuts each record by its range from the
stored member; nothing is extracted, and ``ranges`` does the same over any function that reads a byte range.

Of records with equal payloads the one with the largest page_id is the response; the others are
revisits that refer to it and carry no payload. Copies meet by digest, pre-aggregated, so a payload that a third of the pages
share gathers nowhere.

Defined cases: a null html is an empty payload; a null page_id ranks below all others, and rows that share the
largest page_id (or all lack one) are all responses; a missing url has no target header, and control characters in it
are percent-encoded; an empty table gives no archives and no rows.
"""
from __future__ import annotations

import base64
import hashlib
import json
import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblog.llm.common import pick, table, written
from weblog.session import scratch_dir

#: Payload bytes after which an archive is closed, and the date of all records (nothing is fetched here).
ARCHIVE_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
DATA, INDEX = "archive/data.warc", "indexes/index.cdxj"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _target(url: str) -> str:
    return "".join(c if 32 < ord(c) != 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record, a revisit without payload if ``refers_to`` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_target(url)}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response",
             f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers of a record, with the http headers and the payload of its block."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:20]!r}")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[:int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode().split("\r\n")[1:])}
    return {"headers": headers, "http": fields, "payload": payload}


# ZIP structures: fixed layouts of the public format description.
_LOCAL, _CENTRAL, _END = struct.Struct("<4s5H3L2H"), struct.Struct("<4s6H3L5H2L"), struct.Struct("<4s4H2LH")
_END64, _FIND64 = struct.Struct("<4sQ2H2L4Q"), struct.Struct("<4sLQL")
_FULL32, _FULL16 = 0xFFFFFFFF, 0xFFFF


def pack(members: list[tuple[str, bytes]], comment: bytes = b"") -> bytes:
    """A ZIP archive of stored members, with ZIP64 fields throughout."""
    out, directory = [], []
    at = 0
    for name, data in members:
        crc, path = zlib.crc32(data), name.encode()
        extra = struct.pack("<2H2Q", 1, 16, len(data), len(data))
        local = _LOCAL.pack(b"PK\x03\x04", 45, 0x800, 0, 0, 0x21, crc, _FULL32, _FULL32, len(path), len(extra))
        out += [local, path, extra, data]
        extra = struct.pack("<2H3Q", 1, 24, len(data), len(data), at)
        directory += [_CENTRAL.pack(b"PK\x01\x02", 45, 45, 0x800, 0, 0, 0x21, crc, _FULL32, _FULL32, len(path), len(extra),
                                    0, 0, 0, 0, _FULL32), path, extra]
        at += len(local) + len(path) + len(data) + 20
    size = sum(map(len, directory))
    end64 = _END64.pack(b"PK\x06\x06", 44, 45, 45, 0, 0, len(members), len(members), size, at)
    find = _FIND64.pack(b"PK\x06\x07", 0, at + size, 1)
    end = _END.pack(b"PK\x05\x06", 0, 0, _FULL16, _FULL16, _FULL32, _FULL32, len(comment))
    return b"".join([*out, *directory, end64, find, end, comment])


Read = Callable[[int, int], bytes]


def directory(read: Read, size: int) -> dict[str, tuple[int, int]]:
    """Place and length of every stored member's data, by name, from ranges of an archive of ``size`` bytes."""
    tail_at = max(0, size - _END.size - _FULL16)
    tail = bytes(read(tail_at, size - tail_at))
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and (len(tail) - at < _END.size or at + _END.size + _END.unpack_from(tail, at)[-1] != len(tail)):
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    _, _, _, _, count, length, start, _ = _END.unpack_from(tail, at)
    if count == _FULL16 or length == _FULL32 or start == _FULL32:
        _, _, place, _ = _FIND64.unpack(bytes(read(tail_at + at - _FIND64.size, _FIND64.size)))
        mark, *_, count, length, start = _END64.unpack(bytes(read(place, _END64.size)))
        if mark != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
    entries, found, at = bytes(read(start, length)), {}, 0
    for _ in range(count):
        (mark, _, _, _, method, _, _, _, packed, full, n, extra_n, comment_n, _, _, _, local) = _CENTRAL.unpack_from(entries, at)
        if mark != b"PK\x01\x02":
            raise ValueError("damaged central directory")
        name = entries[at + _CENTRAL.size:at + _CENTRAL.size + n].decode()
        extra = entries[at + _CENTRAL.size + n:at + _CENTRAL.size + n + extra_n]
        while len(extra) >= 4:  # ZIP64 values stand in this order, each only if its field is full
            kind, m = struct.unpack_from("<2H", extra)
            if kind == 1:
                values = list(struct.unpack_from(f"<{m // 8}Q", extra, 4))
                full = values.pop(0) if full == _FULL32 else full
                packed = values.pop(0) if packed == _FULL32 else packed
                local = values.pop(0) if local == _FULL32 else local
            extra = extra[4 + m:]
        if method == 0 and not name.endswith("/"):
            fields = _LOCAL.unpack(bytes(read(local, _LOCAL.size)))
            if fields[0] != b"PK\x03\x04":
                raise ValueError(f"no local header of {name}")
            found[name] = (local + _LOCAL.size + fields[-2] + fields[-1], packed)
        at += _CENTRAL.size + n + extra_n + comment_n
    return found


def ranges(read: Read, size: int) -> Iterator[bytes]:
    """The records of an archive, each by one range of its stored WARC member."""
    members = directory(read, size)
    for name in sorted(members):
        if name.startswith("indexes/") and name.endswith(".cdxj"):
            for line in bytes(read(*members[name])).splitlines():
                entry = json.loads(line[line.index(b"{"):])
                start, length = members["archive/" + entry["filename"]]
                if entry["offset"] + entry["length"] > length:
                    raise ValueError("the index points beyond its member")
                yield bytes(read(start + entry["offset"], entry["length"]))


def archive(records: list[tuple[str, bytes]]) -> bytes:
    """An archive of records, each with the key of its index line."""
    lines, at = [], 0
    for key, raw in records:
        lines.append(f"{key} {json.dumps({'offset': at, 'length': len(raw), 'filename': 'data.warc'})}\n")
        at += len(raw)
    # The last byte is the line feed that the text writer adds.
    return pack([(DATA, b"".join(r for _, r in records)), (INDEX, "".join(lines).encode())], b"\n")[:-1]


def write(pages: DataFrame, path: str, least_payload: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write the records of ``pages`` (page_id, url, html) as archives below ``path``.

    Payloads under ``least_payload`` bytes are always responses.
    """
    p = pick(pages, page_id="page_id", url="url", html="html").withColumn("html", F.coalesce("html", F.lit("")))
    p = p.withColumn("key", F.sha2("html", 256))
    slim = p.where(F.octet_length("html") >= least_payload).groupBy("key").agg(
        F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    revisits = written(slim, "warc-payloads")
    p = p.join(revisits, "key", "left").withColumn(
        "refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("response_id")), F.col("response_id")))

    def run(batches):
        held, size, number = [], 0, 0
        for batch in batches:
            for page_id, url, html, refers_to in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                payload = html.encode()
                raw = record(page_id, url, payload, refers_to)
                held.append((f"{number:012d} {_target(url or '-')}", raw))
                size, number = size + len(raw), number + 1
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([archive(held)], pa.binary())], ["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([archive(held)], pa.binary())], ["value"])

    made = p.select("page_id", "url", "html", "refers_to").mapInArrow(run, "value binary")
    # The cast keeps the bytes as they are; each row is one file.
    made.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload of all records below ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")

    def number(urn: str | None) -> int | None:
        value = (urn or "").removeprefix("<urn:page:").removesuffix(">")
        return int(value) if value else None

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                whole = memoryview(content.as_buffer())
                rows, size = [], 0
                for raw in ranges(lambda at, n, whole=whole: whole[at:at + n], len(whole)):
                    r = parse_record(raw)
                    h = r["headers"]
                    of = h["warc-payload-digest"].removeprefix("sha1:")
                    if h["warc-type"] == "response" and of != digest(r["payload"]):
                        raise ValueError(f"payload of {h['warc-record-id']} doesn't have its digest")
                    rows.append((number(h["warc-record-id"]), h.get("warc-target-uri"), int(r["http"]["content-length"]), of,
                                 h["warc-type"], number(h.get("warc-refers-to")), r["payload"]))
                    size += len(raw)
                    if size > 1 << 20:
                        yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, x)) for x in rows], arrow)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, x)) for x in rows], arrow)

    arrow = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
                       ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                       ("payload", pa.binary())])
    return files.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, "
                                 "record_type string, refers_to long, payload binary")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_dir(spark, 'warc')}/archives"
    write(table(spark, sf_dir, "pages"), path)
    return read(spark, path).drop("url", "payload")
