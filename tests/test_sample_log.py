"""Ten lines of an invented observatory, seven of them usable, with answers worked out by hand."""
from weblog.operators import errors, sessions, temporal, traffic
from weblog.operators.clean import clean_logs
from weblog.operators.parse import parse_lines
from weblog.operators.quality import parse_quality
from weblog.sources import read_lines

OBSERVATORY = """\
cam-1.lab - - [10/Jun/2023:23:50:00 +0000] "GET /sky/north HTTP/1.1" 200 1200 "-" "probe/3"
cam-1.lab - - [11/Jun/2023:00:20:00 +0000] "GET /sky/north HTTP/1.1" 304 0
cam-1.lab - - [11/Jun/2023:00:50:01 +0000] "GET /sky/south HTTP/1.1" 500 40
cam-2.lab - ops [11/Jun/2023:02:20:00 +0200] "PUT /calib/7 HTTP/1.1" 201 -
cam-2.lab - ops [11/Jun/2023:02:21:30 +0200] "PUT /calib/8 HTTP/1.1" 201 64 "-" "probe/3" "night shift"
10.4.4.4 - - [11/Jun/2023:06:00:00 +0000] "OPTIONS * HTTP/1.0" 405 12
10.4.4.4 - - [11/Jun/2023:06:00:59 +0000] "GET /sky/south HTTP/1.1" 500 36
cam-3.lab - - [31/Feb/2023:06:05:00 +0000] "GET /sky/east HTTP/1.1" 200 8
cam-3.lab - - [11/Jun/2023:06:10:00 +0000] "GET /sky/east HTTP/1.1" 701 5
(log rotated)
"""


def test_an_observatory(spark, tmp_path):
    (tmp_path / "observatory.log").write_text(OBSERVATORY)
    parsed = parse_lines(read_lines(spark, str(tmp_path / "observatory.log")))
    seen = parse_quality(parsed).first()
    # The impossible date and the status above 599 match the line pattern, but aren't kept.
    assert (seen.raw_lines, seen.matched_lines, seen.cleaned_lines) == (10, 9, 7)
    logs = clean_logs(parsed)

    hosts = {r.client_ip: r for r in traffic.host_profile(logs).collect()}
    assert {h: (r.total_requests, r.total_bytes, r.distinct_endpoints) for h, r in hosts.items()} == {
        "cam-1.lab": (3, 1240, 2), "cam-2.lab": (2, 64, 2), "10.4.4.4": (2, 48, 2)}
    assert (hosts["cam-2.lab"].average_bytes, hosts["cam-2.lab"].error_rate) == (64.0, 0.0)
    assert hosts["10.4.4.4"].error_rate == 100.0

    # The calibration happened at 00:20 and 00:21 UTC.
    assert {r.hour: r.total_requests for r in temporal.hourly_profile(logs).collect()} == {23: 1, 0: 4, 6: 2}
    assert {str(r.date): r.total_requests for r in temporal.daily_counts(logs).collect()} == {"2023-06-10": 1, "2023-06-11": 6}

    assert {r.status_code: r.frequency for r in errors.status_rates(logs).collect()} == {500: 2 / 7, 405: 1 / 7}
    assert {r.request_path: r["count"] for r in errors.top_paths(logs).collect()} == {"/sky/south": 2, "*": 1}

    # A gap of exactly half an hour stays in the session, one second more opens the next.
    found = sorted((r.client_ip, r.session_id, r.request_count, r.duration_secs) for r in sessions.sessions(logs).collect())
    assert found == [("10.4.4.4", 1, 2, 59), ("cam-1.lab", 1, 2, 1800), ("cam-1.lab", 2, 1, 0), ("cam-2.lab", 1, 2, 90)]
