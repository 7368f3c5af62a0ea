"""Log lines with their places, read in byte ranges: plain files, and gzip files of several members.

Spark's own text source gives a gzip file to one task, and a line doesn't know where it stood. This
Python data source deals byte ranges of files to tasks (neighbouring ones to the same) and gives each line its file and place, which are the same
however the files are split.

A range owns the lines that start behind its first byte and up to its end (a file's first range also the first
line), as splits of text files do: it skips to the first line end and reads on to the end of its last line.

In a gzip file a range owns the members that start in it. The first is found by its magic bytes and *verified*: it must inflate
to its end with the right checksum, and what follows must be the end of the file or begin to inflate, too. Members from there
on follow each other. Lines may cross members. A file of one member is still one task: deflate can't be entered midway.

Places: ``member`` is the byte of the file at which the line's gzip member starts (0 in plain files), ``place`` the
byte of the line in what that member inflates to (in plain files: in the file).

Files are listed by Spark, and opened in the tasks by ``pyarrow.fs``: local and mounted folders, and the stores it knows.
For any other store, and other codecs, use ``text.read_lines``.
"""
from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from weblog.session import default_parallelism

RANGE_BYTES, CHUNK, BATCH_BYTES = 128 << 20, 1 << 20, 4 << 20
#: Read behind a range's end for the rest of its last line, and lines that go to Spark at once.
BEHIND, BATCH_LINES = 4 << 10, 10_000
#: How a gzip member begins (magic and the deflate method), and its reserved flags.
MAGIC, RESERVED = b"\x1f\x8b\x08", 0xE0
SCHEMA = "value string, file string, member long, place long"


@dataclass
class Ranges(InputPartition):
    """(path, length, start, end) of what one task reads, range by range."""

    ranges: list[tuple[str, int, int, int]]


def plan_ranges(files: list[tuple[str, int]], range_bytes: int) -> list[list[tuple[str, int, int, int]]]:
    """Ranges of about ``range_bytes``; small files share a task."""
    out: list[list[tuple[str, int, int, int]]] = []
    held = range_bytes
    for path, length in files:
        for start in range(0, length, range_bytes):
            end = min(start + range_bytes, length)
            if held + end - start > range_bytes:
                out.append([])
                held = 0
            out[-1].append((path, length, start, end))
            held += end - start
    return out


def plan_tasks(files: list[tuple[str, int]], range_bytes: int, tasks: int) -> list[list[tuple[str, int, int, int]]]:
    """What each task reads: neighbouring whole ranges, dealt to about ``tasks`` tasks, or to more of up to RANGE_BYTES each.

    So the number of tasks, each of which costs a start, doesn't grow with the number of ranges.
    """
    share = min(-(-sum(length for _, length in files) // max(1, tasks)), RANGE_BYTES)
    return plan_ranges(files, max(1, share // range_bytes) * range_bytes)


def _open(path: str):
    from pyarrow import fs
    system, at = fs.FileSystem.from_uri(path)
    return system.open_input_file(at)


def _inflates(source, start: int, length: int, whole: bool) -> int | None:
    """Where the member that starts at ``start`` ends; None if none does. Not ``whole``: only its first chunk is tried."""
    inflater, at = zlib.decompressobj(wbits=31), start
    try:
        while at < length:
            chunk = source.read_at(min(CHUNK, length - at), at)
            at += len(chunk)
            while chunk:
                inflater.decompress(chunk, CHUNK)
                chunk = inflater.unconsumed_tail
                if inflater.eof:
                    return at - len(inflater.unused_data)
            if not whole:
                return at
    except zlib.error:
        return None
    return None


def _after_padding(source, at: int, length: int) -> int:
    """The next byte that isn't zero: members may be padded."""
    while at < length:
        chunk = source.read_at(min(CHUNK, length - at), at)
        if rest := chunk.lstrip(b"\0"):
            return at + len(chunk) - len(rest)
        at += len(chunk)
    return length


def first_member(source, start: int, end: int, length: int) -> int | None:
    """The first verified start of a gzip member in [start, end)."""
    if start == 0:
        return 0
    at = start
    while at < end:
        chunk = source.read_at(min(min(CHUNK, end - at) + len(MAGIC), length - at), at)
        found = chunk.find(MAGIC)
        while found >= 0 and at + found < end:
            c = at + found
            if source.read_at(1, c + 3)[:1] and not source.read_at(1, c + 3)[0] & RESERVED:
                stop = _inflates(source, c, length, whole=True)
                if stop is not None:
                    follow = _after_padding(source, stop, length)
                    if follow >= length or _inflates(source, follow, length, whole=False) is not None:
                        return c
            found = chunk.find(MAGIC, found + 1)
        at += CHUNK
    return None


def _members(source, start: int, length: int) -> Iterator[tuple[int, bytes]]:
    """(start of the member, inflated bytes) from a member's start to the end of the file."""
    at = start
    while at < length:
        member, inflater = at, zlib.decompressobj(wbits=31)
        yield member, b""  # also members without content are seen
        while not inflater.eof:
            chunk = source.read_at(min(CHUNK, length - at), at)
            if not chunk:
                raise EOFError(f"a gzip member that starts at byte {member} is cut short")
            at += len(chunk)
            while chunk and not inflater.eof:
                out = inflater.decompress(chunk, CHUNK)
                if out:
                    yield member, out
                chunk = inflater.unconsumed_tail
        at = _after_padding(source, at - len(inflater.unused_data), length)


def _plain(source, start: int, end: int, length: int) -> Iterator[tuple[int, bytes]]:
    """The range and what follows, of which little is read at first."""
    behind = BEHIND
    while start < length:
        if start <= end:
            size = min(CHUNK, end + BEHIND - start)
        else:
            size = behind = min(CHUNK, 2 * behind)
        chunk = source.read_at(min(size, length - start), start)
        yield 0, chunk
        start += len(chunk)


def _line_end(held: bytes | bytearray, whole: bool) -> int:
    """Where the last complete line ends (a final carriage return may be half of a line end)."""
    body = held if whole or not held.endswith(b"\r") else held[:-1]
    return max(body.rfind(b"\n"), body.rfind(b"\r")) + 1


def lines_of(path: str, length: int, start: int, end: int, source=None):
    """Lists of lines (bytes) with their members and places, of one range of one file (``source``, if it is open)."""
    source = source or _open(path)
    zipped = source.read_at(2, 0) == MAGIC[:2]
    if zipped:
        begin = first_member(source, start, end, length)
        if begin is None:
            return
        chunks, origin, last = _members(source, begin, length), 0, None
    else:
        begin = start
        chunks, origin, last = _plain(source, start, end, length), start, end
    seen_at, seen_member = ([], []) if zipped else ([0], [0])
    skipping, held, base, ended = begin > 0, bytearray(), origin, False
    while not ended:
        got = next(chunks, None)
        ended = got is None
        if got is not None:
            member, data = got
            if zipped and (not seen_member or seen_member[-1] != member):
                seen_at.append(base + len(held))
                seen_member.append(member)
                if member >= end and last is None:
                    last = base + len(held)  # lines up to here are this range's
            held += data
            if len(held) < BATCH_BYTES and (last is None or base + len(held) <= last):
                continue
        cut = len(held) if ended else _line_end(held, False)
        if not cut:
            continue
        block = bytes(held[:cut])
        del held[:cut]
        lines = block.splitlines(keepends=True)
        at = base + np.concatenate([[0], np.cumsum([len(x) for x in lines])])[:-1].astype(np.int64)
        base += cut
        if skipping and lines:
            lines, at, skipping = lines[1:], at[1:], False
        if last is not None and len(at) and at[-1] > last:
            keep = int(np.searchsorted(at, last, side="right"))
            lines, at, ended = lines[:keep], at[:keep], True
        if lines:
            of = np.searchsorted(seen_at, at, side="right") - 1
            starts, members = np.array(seen_at, dtype=np.int64), np.array(seen_member, dtype=np.int64)
            yield lines, members[of], at - starts[of]
        if zipped:  # earlier members aren't needed any more
            before = max(0, int(np.searchsorted(seen_at, base, side="right")) - 1)
            seen_at, seen_member = seen_at[before:], seen_member[before:]
        if last is not None and base > last:
            ended = True


class LineRangeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files = [(p, int(n)) for p, n in json.loads(options["files"])]
        self.range_bytes = int(options.get("rangebytes") or options.get("rangeBytes") or RANGE_BYTES)
        self.tasks = int(options.get("tasks") or 64)
        self.encoding = options.get("encoding", "UTF-8")

    def partitions(self):
        return [Ranges(r) for r in plan_tasks(self.files, self.range_bytes, self.tasks)] or [Ranges([])]

    def read(self, partition: Ranges):
        for path, length, first, stop in partition.ranges:
            source, held, rows, size = _open(path), [], 0, 0
            for start in range(first, stop, self.range_bytes):
                for got in lines_of(path, length, start, min(start + self.range_bytes, stop), source):
                    held.append(got)
                    rows, size = rows + len(got[0]), size + sum(map(len, got[0]))
                    if rows >= BATCH_LINES or size >= BATCH_BYTES:
                        yield self._batch(path, held)
                        held, rows, size = [], 0, 0
            if held:
                yield self._batch(path, held)

    def _batch(self, path: str, held: list) -> pa.RecordBatch:
        values = [x.rstrip(b"\r\n").decode(self.encoding, "replace") for lines, _, _ in held for x in lines]
        return pa.RecordBatch.from_arrays(
            [pa.array(values, pa.string()), pa.repeat(pa.scalar(path, pa.string()), len(values)),
             *[pa.array(np.concatenate([h[i] for h in held])) for i in (1, 2)]], ["value", "file", "member", "place"])


class LineRanges(DataSource):
    @classmethod
    def name(cls):
        return "weblog_line_ranges"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return LineRangeReader(self.options)


def list_files(spark: SparkSession, path: str | list[str]) -> list[tuple[str, int]]:
    """(path, length) of the files at a path, folder or glob, listed by Spark."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return sorted((r.path, r.length) for r in found.select("path", "length").collect() if r.length)


def read_line_ranges(spark: SparkSession, path: str | list[str], range_bytes: int = RANGE_BYTES,
                     encoding: str = "UTF-8") -> DataFrame:
    """``value, file, member, place`` of every line below ``path``; see the module's docstring.

    Ranges are dealt to at least four tasks per core, if there are as many.
    """
    spark.dataSource.register(LineRanges)
    return (spark.read.format("weblog_line_ranges").option("files", json.dumps(list_files(spark, path)))
            .option("rangeBytes", str(int(range_bytes))).option("tasks", str(4 * default_parallelism(spark)))
            .option("encoding", encoding).load())


def sample_lines_by_place(lines: DataFrame, percent: float, seed: int = 42, file="file") -> DataFrame:
    """A Bernoulli sample of about ``percent`` % of the lines of ``read_line_ranges``.

    A line is kept when the first 32 bits of the MD5 of ``seed:file:member:place`` fall below the share. Every line is
    drawn for itself, equal lines too, and the sample is the same for any split, rerun or engine. ``file`` is
    a column or expression that names the file; by default its full path.
    """
    if percent < 0:
        raise ValueError("percent must not be negative")
    file = F.col(file) if isinstance(file, str) else file
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), file, F.col("member").cast("string"), F.col("place").cast("string")))
    return lines.where(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") < int(percent / 100.0 * 2**32))
