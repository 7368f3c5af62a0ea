import base64
import hashlib
import io
import zipfile

import pytest
from pyspark.sql import Row

from weblog.llm import warc
from weblog.session import scratch_dir

SF = "/root/testdata/sf0.001"


def want(pages):
    """(page_id, bytes, digest, type, refers_to) by brute force."""
    groups = {}
    for page_id, _, html in pages:
        groups.setdefault(html or "", []).append(page_id)
    out = []
    for page_id, _, html in pages:
        b = (html or "").encode()
        ids = [i for i in groups[html or ""] if i is not None]
        most = max(ids) if ids else None
        own = page_id == most
        out.append((page_id, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(),
                    "response" if own else "revisit", None if own else most))
    return sorted(out, key=repr)


def rows(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=repr)


def test_whole_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    assert rows(warc.op6_warc(spark, SF)) == want([tuple(r) for r in pages.select("page_id", "url", "html").collect()])


def test_copies_nulls_and_files(spark):
    given = [Row(page_id=1, url="http://a/1", html="<p>é</p>", payload="x"), Row(page_id=3, url=None, html="<p>é</p>", payload="x"),
             Row(page_id=2, url="http://a/2\n", html="<p>é</p>", payload="x"), Row(page_id=9, url="u", html=None, payload=None),
             Row(page_id=8, url="u", html="", payload="x"), Row(page_id=None, url="u", html="q" * 300000, payload="x"),
             Row(page_id=4, url="u", html="\r\n\r\nPK\x05\x06", payload="x"), Row(page_id=9, url="u", html=None, payload=None)]
    pages = spark.createDataFrame(given, "page_id long, url string, html string, payload string")
    path = f"{scratch_dir(spark, 'warc-test')}/a"
    warc.write(pages, path, archive_bytes=1000)
    back = warc.read(spark, path)
    assert rows(back) == want([(r.page_id, r.url, r.html) for r in given])
    text = {r.page_id: r.payload for r in back.collect() if r.record_type == "response"}
    assert bytes(text[3]) == "<p>é</p>".encode() and bytes(text[4]) == b"\r\n\r\nPK\x05\x06"
    # The files are archives for any other reader, too.
    for r in spark.read.format("binaryFile").load(path).collect():
        with zipfile.ZipFile(io.BytesIO(bytes(r.content))) as z:
            assert z.testzip() is None
            assert {i.compress_type for i in z.infolist()} == {0} and warc.DATA in z.namelist()
    none = f"{scratch_dir(spark, 'warc-test')}/b"
    warc.write(pages.limit(0), none)
    assert warc.read(spark, none).count() == 0


def test_other_writers_archives():
    """Archives without ZIP64 fields, with compressed members and comments between."""
    raw = warc.record(1, "http://a/", b"hello", None)
    line = b'k {"offset": 0, "length": %d, "filename": "data.warc"}\n' % len(raw)
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("datapackage.json", "{}" * 100, compress_type=zipfile.ZIP_DEFLATED)
        z.writestr(warc.DATA, raw)
        z.writestr(warc.INDEX, line)
        z.comment = b"a PK\x05\x06 comment"
    whole = buffer.getvalue()
    got = list(warc.ranges(lambda at, n: whole[at:at + n], len(whole)))
    assert got == [raw] and warc.parse_record(raw)["payload"] == b"hello"


def test_far_members():
    """Places beyond 4 GB, read by range from an archive that exists only where it is read."""
    raw = warc.record(7, None, b"far", None)
    line = b'k {"offset": 0, "length": %d, "filename": "data.warc"}\n' % len(raw)
    packed = warc.pack([(warc.DATA, raw), (warc.INDEX, line)])
    gap = 5 << 30
    # Move everything behind a gap: all stored places grow by it.
    moved = bytearray(packed)
    import struct
    at = 0
    while (at := moved.find(b"PK\x01\x02", at)) >= 0:
        n = struct.unpack_from("<H", moved, at + 28)[0]
        place = at + 46 + n + 4 + 16
        struct.pack_into("<Q", moved, place, struct.unpack_from("<Q", moved, place)[0] + gap)
        at += 4
    end = moved.find(b"PK\x06\x06")
    struct.pack_into("<Q", moved, end + 48, struct.unpack_from("<Q", moved, end + 48)[0] + gap)
    find = moved.find(b"PK\x06\x07")
    struct.pack_into("<Q", moved, find + 8, struct.unpack_from("<Q", moved, find + 8)[0] + gap)
    read = lambda at, n: bytes(max(0, min(gap, at + n) - at)) + bytes(moved[max(0, at - gap):max(0, at + n - gap)])
    assert list(warc.ranges(read, gap + len(moved))) == [raw]


def test_damage_is_an_error():
    with pytest.raises(ValueError):
        warc.directory(lambda at, n: b"x" * n, 100)
