"""Property-based checks: generated log lines parse back to their fields, and
generated request times sessionize like a plain loop."""
import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tests.fixtures_data import session_df
from tests.test_sessions import _brute_force, _sessions
from weblog.operators import sessions as S
from weblog.operators.clean import clean_logs
from weblog.operators.parse import parse_lines

_token = st.text(alphabet=st.characters(min_codepoint=33, max_codepoint=126, blacklist_characters='"'),
                 min_size=1, max_size=12)
_path = st.lists(_token, min_size=1, max_size=3).map(lambda xs: "/" + " ".join(xs))
_record = st.fixed_dictionaries({
    "ip": st.from_regex(r"\A[0-9]{1,3}(\.[0-9]{1,3}){3}\Z"),
    "ts": st.datetimes(min_value=dt.datetime(1990, 1, 1), max_value=dt.datetime(2030, 1, 1)).map(
        lambda d: d.replace(microsecond=0)),
    "method": st.sampled_from(["GET", "POST", "put", "HEAD"]),
    "path": _path,
    "status": st.integers(100, 599),
    "bytes": st.one_of(st.none(), st.integers(0, 10**12)),
    "tail": st.sampled_from(["", ' "-" "UA"', ' "ref" "Mozilla/5.0 (X11)" "-"']),
})

SETTINGS = settings(max_examples=int(__import__("os").environ.get("HYPOTHESIS_EXAMPLES", "15")), deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])


def _line(r):
    b = "-" if r["bytes"] is None else str(r["bytes"])
    return (f'{r["ip"]} - - [{r["ts"].strftime("%d/%b/%Y:%H:%M:%S")} +0000] '
            f'"{r["method"]} {r["path"]} HTTP/1.1" {r["status"]} {b}{r["tail"]}')


@SETTINGS
@given(st.lists(_record, min_size=1, max_size=20))
def test_rendered_lines_parse_back(spark, records):
    df = spark.createDataFrame([(_line(r),) for r in records], "value string")
    got = clean_logs(parse_lines(df)).collect()
    assert len(got) == len(records)
    want = sorted((r["ip"], r["ts"], r["method"].upper(), r["path"], r["status"], r["bytes"])
                  for r in records)
    have = sorted((g.client_ip, g.log_ts, g.http_method, g.request_path, g.status_code,
                   g.response_bytes) for g in got)
    assert have == want


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 20000)), min_size=1, max_size=60),
       st.sampled_from([0, 1, 7, 60, 1800]))
def test_sessions_match_loop(spark, events, timeout):
    assert _sessions(S.sessions(session_df(spark, events), timeout=timeout)) == \
        _brute_force(events, timeout)


_req_chars = st.sampled_from(list("GET/ab \t \u2028\u0085\r\"x1.") )


@SETTINGS
@given(st.lists(st.text(alphabet=_req_chars, max_size=14), min_size=1, max_size=40))
def test_request_split_equals_separate_patterns(spark, requests):
    from pyspark.sql import functions as F
    from weblog.functions.logline import request_parts, split_request
    df = spark.createDataFrame([(r,) for r in requests], "request string")
    fast = request_parts(F.col("request"), split_request(F.col("request")),
                         F.instr("request", "\n") == 0)
    slow = request_parts(F.col("request"))
    rows = df.select(*[fast[k].alias("f_" + k) for k in fast],
                     *[slow[k].alias("s_" + k) for k in slow]).collect()
    for r in rows:
        for k in fast:
            assert r["f_" + k] == r["s_" + k], (k, r)


_line_chars = st.sampled_from(list('1 a-"[]/:+0\\t') + ["\r", "\u0085", "\u2028", "\u2029"])


@SETTINGS
@given(st.lists(st.tuples(_record, st.text(alphabet=_line_chars, max_size=3)), min_size=1, max_size=25))
def test_line_split_equals_per_group_extract(spark, items):
    """Rendered lines with odd trailing characters: the one-match reading equals
    per-group ``regexp_extract`` (the definition)."""
    from pyspark.sql import functions as F
    from weblog.functions.logline import COMBINED_LINE, FIELD_NAMES
    lines = [_line(r) + tail for r, tail in items]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = parse_lines(df).collect()
    want = df.select(F.col("value").rlike(COMBINED_LINE).alias("m"),
                     *[F.regexp_extract("value", COMBINED_LINE, i + 1).alias(n)
                       for i, n in enumerate(FIELD_NAMES)]).collect()
    for g, w in zip(got, want):
        assert g.line_matched == w.m
        assert (g.client_ip, g.remote_ident, g.remote_user, g.ts_raw, g.status_str, g.bytes_str) == \
            (w.client_ip, w.remote_ident, w.remote_user, w.ts_raw, w.status_str, w.bytes_str), repr(g.raw_line)
