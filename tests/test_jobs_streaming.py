import gzip
import json

from tests.fixtures_data import F_LINES
from weblog.sources.logs import read_logs
from weblog.streaming import start_ingest


def _write_log(path, lines, gz=False):
    data = ("\n".join(lines) + "\n").encode()
    if gz:
        with gzip.open(path, "wb") as f:
            f.write(data)
    else:
        path.write_bytes(data)


def test_ingest_job_gzip_by_date(spark, tmp_path, capsys):
    from jobs import ingest
    src = tmp_path / "access.log.gz"
    _write_log(src, F_LINES, gz=True)
    out = tmp_path / "table"
    args = ingest.parse_args(["--raw-log-path", str(src), "--output-parquet-path", str(out),
                              "--partition-by-log-date", "--input-partitions", "4"])
    res = ingest.run(spark, args)
    assert (res["raw_lines"], res["matched_lines"], res["cleaned_lines"], res["read_back"]) == (12, 8, 4, 4)
    t = read_logs(spark, str(out), date_from="2019-01-22", date_to="2019-01-22")
    assert t.count() == 2
    json.dumps(res)


def test_ingest_job_ignore_mode_keeps_table(spark, tmp_path):
    from jobs import ingest
    src = tmp_path / "a.log"
    _write_log(src, F_LINES)
    out = tmp_path / "t"
    base = ["--raw-log-path", str(src), "--output-parquet-path", str(out)]
    ingest.run(spark, ingest.parse_args(base + ["--output-partitions", "2"]))
    _write_log(src, F_LINES[:1])
    res = ingest.run(spark, ingest.parse_args(base + ["--mode", "ignore"]))
    assert res == {"skipped": True, "read_back": 4}


def test_streaming_ingest_exactly_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    out, ckpt = tmp_path / "out", tmp_path / "ckpt"
    _write_log(src / "part1.log", F_LINES)
    q = start_ingest(spark, str(src), str(out), str(ckpt))
    q.awaitTermination(120)
    assert spark.read.parquet(str(out)).count() == 4
    _write_log(src / "part2.log", F_LINES[:3])
    q = start_ingest(spark, str(src), str(out), str(ckpt))  # resume: only the new file
    q.awaitTermination(120)
    assert spark.read.parquet(str(out)).count() == 7


def test_ingest_job_with_output_partitions_counts_exactly(spark, tmp_path):
    from jobs import ingest
    src = tmp_path / "a.log"
    _write_log(src, F_LINES)
    out = tmp_path / "t"
    res = ingest.run(spark, ingest.parse_args(["--raw-log-path", str(src), "--output-parquet-path",
                                               str(out), "--output-partitions", "3"]))
    assert (res["raw_lines"], res["matched_lines"], res["cleaned_lines"], res["read_back"]) == (12, 8, 4, 4)


def test_streaming_ingest_by_date_strict(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    out, ckpt = tmp_path / "out", tmp_path / "ckpt"
    _write_log(src / "a.log", F_LINES)
    q = start_ingest(spark, str(src), str(out), str(ckpt), strict_http_method=True, by_date=True,
                     max_files_per_trigger=1)
    q.awaitTermination(120)
    t = read_logs(spark, str(out))
    assert t.count() == 3  # the FOO request is dropped
    assert sorted(p.name for p in out.iterdir() if p.name.startswith("log_date=")) == \
        ["log_date=2019-01-21", "log_date=2019-01-22"]
