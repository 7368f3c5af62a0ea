"""Raw text lines -> parsed-line table (every line kept, with a match flag)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblog.functions.logline import (
    FIELD_NAMES,
    field_from,
    matched_from,
    parse_log_ts,
    request_parts,
    split_line,
    split_request,
)

PARSED_FIELDS = ["raw_line", "line_matched", "client_ip", "remote_ident", "remote_user",
                 "ts_raw", "log_ts", "http_method", "request_path", "http_version",
                 "status_str", "bytes_str"]


def parse_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Split each combined-log line into typed and raw columns.

    Output: raw_line, line_matched, client_ip, remote_ident, remote_user, ts_raw,
    log_ts (null when unparseable), http_method, request_path, http_version,
    status_str, bytes_str. Lines that do not match keep their row, with ``''``
    fields and ``line_matched = false``; ``clean_logs`` drops them.

    Plan shape: the pattern runs once per line in the first projection; the
    second and third projections only index into its result (Catalyst keeps
    them apart, since inlining would repeat the regex). The result passes a
    one-row ``inline``: Catalyst does not push a later filter below a
    generator whose output it references, so cleaning filters see finished
    columns instead of re-running the pattern once per referenced field
    (measured: parse + clean 4x faster than without it).
    """
    parts, plain = split_line(F.col(value))
    s1 = lines.select(F.col(value).alias("raw_line"), parts.alias("_parts"),
                      plain.alias("_plain"))
    raw, p, pl = F.col("raw_line"), F.col("_parts"), F.col("_plain")
    s2 = s1.select("raw_line", "_plain", matched_from(raw, p, pl).alias("line_matched"),
                   *[field_from(raw, p, pl, i).alias(n) for i, n in enumerate(FIELD_NAMES)])
    s2 = s2.withColumn("_req_parts", split_request(F.col("request")))
    req = request_parts(F.col("request"), F.col("_req_parts"), F.col("_plain"))
    s3 = s2.select(
        "raw_line", "line_matched", "client_ip", "remote_ident", "remote_user", "ts_raw",
        parse_log_ts(F.col("ts_raw")).alias("log_ts"),
        req["http_method"].alias("http_method"),
        req["request_path"].alias("request_path"),
        req["http_version"].alias("http_version"),
        "status_str", "bytes_str",
    )
    return s3.select(F.inline(F.array(F.struct(*PARSED_FIELDS))))
