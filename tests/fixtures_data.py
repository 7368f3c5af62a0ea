"""Hand-written inputs with stated answers (FIXTURES.md §3-§6)."""
import datetime as dt

# F-LINES: twelve raw lines.
F_LINES = [
    '10.0.0.1 - - [22/Jan/2019:03:56:14 +0330] "GET /a HTTP/1.1" 200 100 "-" "UA" "-"',
    '10.0.0.1 - - [22/Jan/2019:03:26:14 +0330] "GET /b HTTP/1.1" 404 - "-" "UA"',
    '10.0.0.2 - frank [21/Jan/2019:23:59:59 +0000] "post /c d HTTP/1.0" 500 7',
    '10.0.0.2 - - [22/Jan/2019:00:00:00 +0000] "GET /e HTTP/1.1" 200 5 "-"',
    'bad line without structure',
    '',
    '10.0.0.3 - - [22/Jan/2019:00:00:00 +0000] "GET /old" 200 9',
    '10.0.0.3 - - [22/Jan/2019:00:00:00 +0000] "GET /x HTTP/1.1" 600 9',
    '10.0.0.3 - - [99/Jan/2019:00:00:00 +0000] "GET /x HTTP/1.1" 200 9',
    '10.0.0.3 - - [22/Jan/2019:00:00:00 +0000] "GET /x HTTP/1.1" 200 9 "-" "U\\"A"',
    '10.0.0.4 - - [22/Jan/2019:00:00:00 +0000] "FOO /x HTTP/1.1" 200 9',
    '10.0.0.4 - - [22/Jan/2019:00:00:00 +0000] "-" 400 0',
]

T0 = dt.datetime(2020, 1, 1)

# F-SESSIONS: (key, epoch offset seconds)
F_SESSIONS = [("a", 0), ("a", 1800), ("a", 3601), ("a", 3601), ("a", 5400), ("b", 10)]


def lines_df(spark, lines=F_LINES):
    return spark.createDataFrame([(x,) for x in lines], "value string")


def cleaned(spark):
    from weblog.operators.clean import clean_logs
    from weblog.operators.parse import parse_lines
    return clean_logs(parse_lines(lines_df(spark)))


def session_df(spark, events=F_SESSIONS):
    return spark.createDataFrame(
        [(k, T0 + dt.timedelta(seconds=s)) for k, s in events],
        "client_ip string, log_ts timestamp")
