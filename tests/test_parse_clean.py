import datetime as dt

from pyspark.sql import functions as F

from tests.fixtures_data import F_LINES, cleaned, lines_df
from weblog.operators.clean import clean_logs
from weblog.operators.parse import parse_lines
from weblog.operators.quality import observed, parse_quality
from weblog.schema import ACCESS_LOG_COLUMNS, ACCESS_LOG_SCHEMA, conform


def test_match_flags_follow_the_pattern(spark):
    p = parse_lines(lines_df(spark)).select("line_matched").collect()
    flags = [r.line_matched for r in p]
    assert flags == [True, True, True, False, False, False, True, True, True, False, True, True]


def test_parsed_fields(spark):
    rows = parse_lines(lines_df(spark)).collect()
    r1, r2, r3 = rows[0], rows[1], rows[2]
    assert r1.log_ts == dt.datetime(2019, 1, 22, 0, 26, 14)  # +0330 offset applied, UTC
    assert (r1.http_method, r1.request_path, r1.http_version) == ("GET", "/a", "HTTP/1.1")
    assert r2.bytes_str == "-"
    assert (r3.http_method, r3.request_path, r3.remote_user) == ("post", "/c d", "frank")
    old = rows[6]
    assert (old.request_path, old.http_version) == ("", "/old")  # HTTP/0.9 request: no path
    assert rows[8].log_ts is None  # day 99 does not parse, and does not raise under ANSI
    assert rows[4].client_ip == "" and rows[4].log_ts is None


def test_clean_keeps_four_rows(spark):
    c = cleaned(spark)
    assert c.columns == ACCESS_LOG_COLUMNS
    rows = {(r.client_ip, r.request_path): r for r in c.collect()}
    assert set(rows) == {("10.0.0.1", "/a"), ("10.0.0.1", "/b"), ("10.0.0.2", "/c d"),
                         ("10.0.0.4", "/x")}
    assert rows[("10.0.0.1", "/b")].response_bytes is None
    assert rows[("10.0.0.1", "/b")].log_date == dt.date(2019, 1, 21)
    assert rows[("10.0.0.2", "/c d")].http_method == "POST"
    assert rows[("10.0.0.2", "/c d")].status_code == 500


def test_strict_methods_drop_unknown_verb(spark):
    c = clean_logs(parse_lines(lines_df(spark)), strict_http_method=True)
    assert c.count() == 3
    assert c.where(F.col("http_method") == "FOO").count() == 0


def test_parse_quality_counts(spark):
    q = parse_quality(parse_lines(lines_df(spark))).collect()[0]
    assert (q.raw_lines, q.matched_lines, q.cleaned_lines) == (12, 8, 4)
    assert abs(q.match_rate - 8 / 12) < 1e-12 and abs(q.parse_rate - 4 / 12) < 1e-12
    s = parse_quality(parse_lines(lines_df(spark)), strict_http_method=True).collect()[0]
    assert s.cleaned_lines == 3


def test_parse_quality_empty_input(spark):
    q = parse_quality(parse_lines(lines_df(spark, []))).collect()[0]
    assert (q.raw_lines, q.matched_lines, q.cleaned_lines) == (0, 0, 0)
    assert q.match_rate is None and q.parse_rate is None


def test_observed_counts_during_write(spark, tmp_path):
    parsed, obs = observed(parse_lines(lines_df(spark)))
    clean_logs(parsed).write.parquet(str(tmp_path / "out"))
    m = obs.get
    assert (m["raw_lines"], m["matched_lines"], m["cleaned_lines"]) == (12, 8, 4)


def test_line_with_newline_uses_exact_path(spark):
    from weblog.functions.logline import COMBINED_LINE, FIELD_NAMES
    odd = [F_LINES[0], "10.0.0.9 - - [22/Jan/2019:00:00:00 +0000] \"GET /a\nb HTTP/1.1\" 200 1"]
    df = lines_df(spark, odd)
    rows = parse_lines(df).collect()
    # Per-group regexp_extract is the definition the one-match split must equal.
    ref = df.select(F.col("value").rlike(COMBINED_LINE).alias("m"),
                    *[F.regexp_extract("value", COMBINED_LINE, i + 1).alias(n)
                      for i, n in enumerate(FIELD_NAMES)]).collect()
    for got, want in zip(rows, ref):
        assert got.line_matched == want.m
        assert (got.client_ip, got.ts_raw, got.status_str, got.bytes_str) == \
               (want.client_ip, want.ts_raw, want.status_str, want.bytes_str)
    # "." does not cross the newline, so the path is empty and cleaning drops the row.
    assert rows[1].line_matched and rows[1].request_path == ""


def test_conform_casts_and_orders(spark):
    c = cleaned(spark)
    shuffled = c.select(*reversed(c.columns)).withColumn("status_code", F.col("status_code").cast("long"))
    out = conform(shuffled)
    assert out.columns == ACCESS_LOG_COLUMNS
    assert out.schema["status_code"].dataType == ACCESS_LOG_SCHEMA["status_code"].dataType


def test_conform_fails_on_missing_column(spark):
    import pytest
    with pytest.raises(ValueError):
        conform(cleaned(spark).drop("log_date"))


def test_final_line_terminator_takes_exact_path(spark):
    # "$" also matches before a final line terminator; the value's last
    # character must not stick to the last field.
    from weblog.functions.logline import request_parts, split_request
    base = '10.0.0.1 - - [22/Jan/2019:00:00:00 +0000] "GET /a HTTP/1.1" 200 123'
    rows = parse_lines(lines_df(spark, [base + "\u2028", base + "\u0085"])).collect()
    assert [r.bytes_str for r in rows] == ["123", "123"]
    df = spark.createDataFrame([("1 1 1\r",), ("GET /x HTTP/1.1\u2028",)], "request string")
    fast = request_parts(F.col("request"), split_request(F.col("request")), F.lit(True))
    slow = request_parts(F.col("request"))
    got = df.select(*[fast[k].alias(k) for k in fast]).collect()
    want = df.select(*[slow[k].alias(k) for k in slow]).collect()
    assert got == want
    assert got[0].http_version == "1"
