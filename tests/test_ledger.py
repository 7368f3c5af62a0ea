import os

import pytest
from pyspark.sql import functions as F

from jobs import ingest
from tests.fixtures_data import F_LINES, cleaned
from weblog.sources import committed, ledger, snapshots, write_logs


def run(spark, tmp_path, *more):
    return ingest.run(spark, ingest.parse_args(["--raw-log-path", str(tmp_path / "raw"), "--table", str(tmp_path / "t"), *more]))


def table(spark, tmp_path):
    return sorted(r.request_path for r in snapshots.read(spark, str(tmp_path / "t"), "logs").collect())


def line(path):
    return f'10.9.0.1 - - [05/Mar/2021:10:00:00 +0000] "GET {path} HTTP/1.1" 200 5 "-" "UA"\n'


def test_only_new_files_are_parsed(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "a.log").write_text(line("/a"))
    (raw / "b.log").write_text(line("/b"))
    assert run(spark, tmp_path) == {"version": 1, "files": 2, "redone": [], "read_back": 2}
    assert run(spark, tmp_path)["files"] == 0
    first = set((tmp_path / "t" / "data").rglob("part-*.parquet"))
    (raw / "c.log").write_text(line("/c"))
    got = run(spark, tmp_path)
    assert (got["version"], got["files"], got["redone"]) == (2, 1, []) and table(spark, tmp_path) == ["/a", "/b", "/c"]
    assert first < set((tmp_path / "t" / "data").rglob("part-*.parquet"))
    (raw / "c.log").unlink()  # rotated away: its rows stay
    assert run(spark, tmp_path)["files"] == 0 and table(spark, tmp_path) == ["/a", "/b", "/c"]


def test_a_changed_file_redoes_its_batch(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "a.log").write_text(line("/a"))
    (raw / "b.log").write_text(line("/b"))
    run(spark, tmp_path)
    (raw / "c.log").write_text(line("/c"))
    run(spark, tmp_path)
    (raw / "a.log").write_text(line("/a") + line("/a2"))
    got = run(spark, tmp_path)
    assert got["files"] == 2 and got["redone"] == ["batch=000000000001"]
    assert table(spark, tmp_path) == ["/a", "/a2", "/b", "/c"]
    # The same length, but written again.
    (raw / "c.log").write_text(line("/x"))
    os.utime(raw / "c.log", (1, 1))
    assert run(spark, tmp_path)["files"] == 1 and table(spark, tmp_path) == ["/a", "/a2", "/b", "/x"]
    assert ledger.ledger(spark, str(tmp_path / "t")).count() == 3
    (raw / "b.log").unlink()
    (raw / "a.log").write_text(line("/gone"))
    with pytest.raises(ValueError, match="gone"):
        run(spark, tmp_path)
    assert table(spark, tmp_path) == ["/a", "/a2", "/b", "/x"]


def test_other_settings_parse_again(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.log").write_text("\n".join(F_LINES) + "\n")
    first = run(spark, tmp_path)
    assert first["read_back"] == 4
    strict = run(spark, tmp_path, "--strict-http-method")
    assert strict["redone"] == ["batch=000000000001"] and strict["read_back"] == 3
    assert run(spark, tmp_path, "--strict-http-method")["files"] == 0


def test_a_broken_run_counts_no_input_as_done(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.log").write_text(line("/a"))
    root = str(tmp_path / "t")
    broken = lambda paths: spark.read.text(paths).select(F.raise_error(F.lit("broken")).alias("v"))
    with pytest.raises(Exception, match="broken"):
        ledger.ingest_new(spark, str(tmp_path / "raw"), root, broken)
    assert ledger.ledger(spark, root).count() == 0
    assert run(spark, tmp_path)["files"] == 1


def test_ignore_replaces_a_broken_write(spark, tmp_path):
    out = tmp_path / "t"
    (out / "_temporary").mkdir(parents=True)
    (out / "part-00000-x.snappy.parquet").write_bytes(b"half a file")
    write_logs(cleaned(spark), str(out), mode="ignore")
    assert committed(spark, str(out)) and spark.read.parquet(str(out)).count() == 4
    write_logs(cleaned(spark).limit(1), str(out), mode="ignore")
    assert spark.read.parquet(str(out)).count() == 4


def test_ranges_and_samples_of_a_job(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.log").write_text("".join(line(f"/{i}") for i in range(500)))
    whole = run(spark, tmp_path, "--input-range-bytes", "1000")
    assert whole["read_back"] == 500
    part = run(spark, tmp_path, "--input-range-bytes", "1000", "--sample-percent", "10")
    kept = table(spark, tmp_path)
    assert 20 < part["read_back"] < 90 and len(kept) == part["read_back"]
    again = run(spark, tmp_path, "--input-range-bytes", "7000", "--sample-percent", "10")
    assert again["files"] == 0  # the sample doesn't depend on the ranges, so they aren't a setting
