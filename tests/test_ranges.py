import gzip
import random

import pytest
from pyspark.sql import functions as F

from weblog.sources import ranges as R
from weblog.sources.text import read_lines


def read_all(files, range_bytes):
    """All (line, member, place) of the ranges, file by file."""
    out = {}
    for part in R.plan_ranges(files, range_bytes):
        for path, length, start, end in part:
            for lines, member, place in R.lines_of(path, length, start, end):
                out.setdefault(path, []).extend(zip((x.rstrip(b"\r\n") for x in lines), member.tolist(), place.tolist()))
    return out


def expected(raw: bytes):
    at, out = 0, []
    for x in raw.splitlines(keepends=True):
        out.append((x.rstrip(b"\r\n"), 0, at))
        at += len(x)
    return out


@pytest.mark.parametrize("raw", [
    b"", b"\n", b"a", b"a\nb", b"a\n\nb\n", b"\r\n\r\nab\r\ncd\re\n", b"x" * 50 + b"\n" + b"y" * 3, b"a\r", b"\n\n\n\n",
    b"one\ntwo\nthree\nfour\n", b"\xff\xfe\n\x00\n"])
def test_plain_files_in_any_ranges(tmp_path, raw, monkeypatch):
    p = tmp_path / "a.log"
    p.write_bytes(raw)
    files = [(f"file://{p}", len(raw))]
    for chunk in (1, 2, 5, 1 << 20):
        monkeypatch.setattr(R, "CHUNK", chunk)
        monkeypatch.setattr(R, "BATCH_BYTES", chunk)
        for size in (1, 2, 3, 7, 1000):
            assert read_all(files, size).get(files[0][0], []) == expected(raw), (chunk, size)


def members_of(pieces, level=6, pad=b""):
    """A gzip file of one member for each piece, and where each starts and what it holds."""
    out, starts = b"", []
    for piece in pieces:
        starts.append(len(out))
        out += gzip.compress(piece, compresslevel=level) + pad
    return out, starts


def placed(pieces, starts):
    """Each line's member and place, from the whole stream."""
    stream = b"".join(pieces)
    begins, at = [], 0
    for s, piece in zip(starts, pieces):
        begins.append((at, s))
        at += len(piece)
    out = []
    for line, _, at in expected(stream):
        b, s = [x for x in begins if x[0] <= at][-1]
        out.append((line, s, at - b))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_gzip_members_in_any_ranges(tmp_path, seed, monkeypatch):
    rng = random.Random(seed)
    text = "".join(f"line {i} {'é' * rng.randint(0, 30)}{rng.choice(['', chr(13)])}\n" for i in range(300)).encode()
    cuts = sorted(rng.sample(range(len(text)), 39))  # lines cross members
    pieces = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
    pieces[3:3] = [b"", b""]
    raw, starts = members_of(pieces, level=0 if seed == 1 else 6, pad=b"\0\0" if seed == 2 else b"")
    p = tmp_path / "a.gz"
    p.write_bytes(raw)
    monkeypatch.setattr(R, "CHUNK", 512)
    files, want = [(f"file://{p}", len(raw))], placed(pieces, starts)
    for size in (100, 900, 5000, 1 << 20):
        got = read_all(files, size)[files[0][0]]
        assert got == want, size


def test_false_starts_are_not_taken(tmp_path):
    # A stored member whose content holds magic bytes, a cut gzip file, and a whole one.
    inner = gzip.compress(b"inner\n")
    content = b"before\n" + R.MAGIC + b"\0junk\n" + inner[:-4] + b"\n" + inner + b"behind\n"
    raw, starts = members_of([content, b"second\n"], level=0)
    p = tmp_path / "a.gz"
    p.write_bytes(raw)
    files = [(f"file://{p}", len(raw))]
    for size in (16, 40, 200):
        assert read_all(files, size)[files[0][0]] == placed([content, b"second\n"], starts)
    p.write_bytes(raw[:-3])
    with pytest.raises(EOFError):
        read_all([(f"file://{p}", len(raw) - 3)], 1000)


def test_forty_members_are_read_by_many_tasks(spark, tmp_path):
    pieces = ["".join(f"host{m} row {i}\n" for i in range(2000)).encode() for m in range(40)]
    raw, _ = members_of(pieces)
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.gz").write_bytes(raw)
    (tmp_path / "logs" / "b.log").write_bytes(b"plain\n")
    lines = R.read_line_ranges(spark, str(tmp_path / "logs"), range_bytes=len(raw) // 10)
    per_task = [r["count"] for r in lines.groupBy(F.spark_partition_id()).count().collect()]
    assert len(per_task) >= 8 and max(per_task) < 20000
    want = sorted(r.value for r in read_lines(spark, str(tmp_path / "logs")).collect())
    assert sorted(r.value for r in lines.collect()) == want and len(want) == 80001
    # One member: one task, all rows.
    (tmp_path / "one.gz").write_bytes(gzip.compress(b"".join(pieces)))
    one = R.read_line_ranges(spark, str(tmp_path / "one.gz"), range_bytes=10000)
    assert [r["count"] for r in one.groupBy(F.spark_partition_id()).count().collect()] == [80000]


def test_sample_is_drawn_by_place(spark, tmp_path):
    p = tmp_path / "a.log"
    p.write_text("same\n" * 4000)  # equal lines are drawn each for itself
    kept = lambda size, **kw: {r.place for r in R.sample_lines_by_place(
        R.read_line_ranges(spark, str(p), range_bytes=size), 10, **kw).collect()}
    whole = kept(1 << 20)
    assert 300 < len(whole) < 500
    assert kept(500) == whole  # 40 splits
    assert len(whole & kept(1 << 20, seed=7)) < 100
    lines = R.read_line_ranges(spark, str(p))
    assert R.sample_lines_by_place(lines, 0).count() == 0 and R.sample_lines_by_place(lines, 100).count() == 4000
    with pytest.raises(ValueError):
        R.sample_lines_by_place(lines, -1)


def test_tasks_do_not_grow_with_the_ranges(spark, tmp_path):
    raw = "".join(f"line {i}\n" for i in range(20000)).encode()
    (tmp_path / "a.log").write_bytes(raw)
    lines = R.read_line_ranges(spark, str(tmp_path / "a.log"), range_bytes=100)  # over 2,000 ranges
    assert 8 <= lines.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism + 1
    got = sorted((r.place, r.value.encode()) for r in lines.collect())
    assert got == [(at, x) for x, _, at in expected(raw)]
    # Whole neighbouring ranges, each once; large inputs go to more tasks.
    files = [("a", 1050), ("b", 30), ("c", 0)]
    spans = [s for task in R.plan_tasks(files, 100, 3) for s in task]
    assert spans == [("a", 1050, 0, 300), ("a", 1050, 300, 600), ("a", 1050, 600, 900), ("a", 1050, 900, 1050), ("b", 30, 0, 30)]
    assert len(R.plan_tasks([("a", 100 * R.RANGE_BYTES)], 20_000, 3)) >= 100


def test_a_small_range_reads_little(tmp_path):
    raw = b"x" * 99 + b"\n"
    (tmp_path / "a.log").write_bytes(raw * 50_000)

    class Counted:
        source, read = R._open(f"file://{tmp_path}/a.log"), 0

        def read_at(self, size, at):
            self.read += size
            return self.source.read_at(size, at)

    source = Counted()
    got = [p for _, _, place in R.lines_of("", 5_000_000, 20_000, 40_000, source) for p in place.tolist()]
    assert got == list(range(20_100, 40_001, 100)) and source.read < 60_000
