"""DuckDB SQL oracles for the query keys (independent formulations).

Run against views of the test tables (``events``, ``customer``, ``lineitem``,
``orders``). Sessions are computed the textbook way here (LAG over every row
of a client, then a running SUM), which checks the bucketed plan of
``weblog.operators.sessions`` against a different method.
"""
from __future__ import annotations

from weblog.fixtures import VARIANTS, projection_sql
from weblog.plans.catalog import LONG_TIMEOUT, SHORT_TIMEOUT

LOGS = f"logs AS ({projection_sql('duckdb')})"
LOGS_ID = f"logs AS ({projection_sql('duckdb', with_event_id=True)})"
LOGS_STRICT = f"logs AS ({projection_sql('duckdb', strict_methods=True)})"
LOGS_NULL = f"logs AS ({projection_sql('duckdb', null_clients=True)})"
LOGS_HOT = f"logs AS ({projection_sql('duckdb', hot_client=True)})"

ERR = "status_code >= 400 AND status_code < 600"
ERR_RATE = (f"round(CAST(sum(CASE WHEN {ERR} THEN 1 ELSE 0 END) AS DOUBLE) "
            "/ CAST(count(*) AS DOUBLE) * 100.0, 6)")
EPOCH = "CAST(floor(epoch(log_ts)) AS BIGINT)"
ALL_COLS = ("client_ip, log_ts, http_method, request_path, http_version, status_code, "
            "response_bytes, log_date")

HOST_PROFILE = f"""
SELECT client_ip, count(*) AS total_requests,
       CAST(sum(response_bytes) AS BIGINT) AS total_bytes,
       round(avg(response_bytes), 6) AS average_bytes,
       {ERR_RATE} AS error_rate,
       count(DISTINCT request_path) AS distinct_endpoints
FROM logs GROUP BY client_ip
"""

HOURLY = f"""
SELECT CAST(hour(log_ts) AS INTEGER) AS hour, count(*) AS total_requests,
       CAST(sum(response_bytes) AS BIGINT) AS total_bytes,
       round(avg(response_bytes), 6) AS average_bytes,
       {ERR_RATE} AS error_rate
FROM logs GROUP BY 1
"""

DAILY = "SELECT CAST(log_ts AS DATE) AS date, count(*) AS total_requests FROM logs GROUP BY 1"


def _session_rows(timeout: int) -> str:
    return f"""
lagged AS (
  SELECT client_ip, log_ts,
         LAG(log_ts) OVER (PARTITION BY client_ip ORDER BY log_ts) AS prev_ts
  FROM logs
),
flagged AS (
  SELECT client_ip, log_ts, prev_ts,
         {EPOCH} - CAST(floor(epoch(prev_ts)) AS BIGINT) AS gap_secs,
         CASE WHEN prev_ts IS NULL THEN 1
              WHEN {EPOCH} - CAST(floor(epoch(prev_ts)) AS BIGINT) > {timeout} THEN 1
              ELSE 0 END AS is_new_session
  FROM lagged
),
with_id AS (
  SELECT *, CAST(SUM(is_new_session) OVER (PARTITION BY client_ip ORDER BY log_ts
               RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS session_id
  FROM flagged
),
sess AS (
  SELECT client_ip, session_id, count(*) AS request_count,
         max({EPOCH}) - min({EPOCH}) AS duration_secs,
         min(log_ts) AS first_ts, max(log_ts) AS last_ts
  FROM with_id GROUP BY client_ip, session_id
),
per_host AS (
  SELECT client_ip, count(session_id) AS session_count,
         round(avg(duration_secs), 6) AS avg_duration_secs,
         round(avg(request_count), 6) AS avg_requests_per_session
  FROM sess GROUP BY client_ip
)"""


def _with_sessions(timeout: int, select: str, logs: str = LOGS) -> str:
    return f"WITH {logs},{_session_rows(timeout)}\n{select}"


def _top(table_sql: str, metric: str, keys: str, n: int = 10) -> str:
    return f"SELECT * FROM ({table_sql}) t ORDER BY {metric} DESC NULLS LAST, {keys} LIMIT {n}"


MEASUREMENTS = """measurements AS (
  SELECT 'lineitem' AS benchmark_id, l_linenumber AS scale_pct, l_returnflag AS query,
         l_linestatus AS api, l_orderkey AS run, l_extendedprice AS elapsed_sec
  FROM lineitem)"""

KEYED_RUNS = """runs AS (
  SELECT CAST(year(o_orderdate) AS VARCHAR) AS benchmark_id,
         CAST(month(o_orderdate) AS INTEGER) AS scale_pct,
         o_orderstatus AS query, o_orderpriority AS api, o_orderkey AS run,
         o_totalprice AS elapsed_sec
  FROM orders)"""

PAYLOAD_RUNS = """pruns AS (
  SELECT CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_suppkey AS VARCHAR) AS benchmark_id,
         100 AS scale_pct, l_returnflag AS query, l_linestatus AS api,
         l_partkey AS run, l_extendedprice AS elapsed_sec
  FROM lineitem)"""

STAGES = """stages AS (
  SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) || '-'
           || CAST(l_suppkey AS VARCHAR) AS stage_id,
         l_linenumber AS scale_pct, l_returnflag AS query, l_linestatus AS api,
         l_shipdate AS submitted,
         CAST(floor(l_quantity) AS BIGINT) AS num_tasks,
         CAST(floor(l_extendedprice * 100) AS BIGINT) AS shuffle_read_bytes,
         CAST(floor(l_extendedprice * l_discount * 100) AS BIGINT) AS shuffle_write_bytes,
         CAST(floor(l_tax * 1000) AS BIGINT) AS disk_bytes_spilled,
         CAST(floor(l_quantity * 10) AS BIGINT) AS executor_deserialize_time,
         CAST(floor(l_extendedprice * 1000000) AS BIGINT) AS executor_cpu_time
  FROM lineitem)"""


def _summary(sample: bool) -> str:
    std = "stddev_samp" if sample else "stddev_pop"
    return f"""WITH {MEASUREMENTS}
SELECT scale_pct, query, api, count(*) AS num_runs,
       round(avg(elapsed_sec), 6) AS avg_elapsed_sec,
       round({std}(elapsed_sec), 6) AS std_elapsed_sec
FROM measurements GROUP BY scale_pct, query, api"""


PARSED = f"""WITH {LOGS}
SELECT true AS line_matched, client_ip, log_ts, http_method, request_path, http_version,
       CAST(status_code AS VARCHAR) AS status_str,
       coalesce(CAST(response_bytes AS VARCHAR), '-') AS bytes_str
FROM logs"""

CLEANED = f"WITH {LOGS} SELECT {ALL_COLS} FROM logs"

# What each kind of line in VARIANTS must give, from the events and not from the lines.
_KIND = f"['{"','".join(VARIANTS)}'][event_id % {len(VARIANTS)} + 1]"
VARIANT_LOGS = f"{LOGS_ID}, v AS (SELECT *, {_KIND} AS kind FROM logs)"
PARSED_VARIANTS = f"""WITH {VARIANT_LOGS}
SELECT kind <> 'cut' AS line_matched,
       CASE WHEN kind = 'cut' THEN '' ELSE client_ip END AS client_ip,
       CASE WHEN kind NOT IN ('cut', 'bad_month') THEN log_ts END AS log_ts,
       CASE kind WHEN 'cut' THEN '' WHEN 'lower_verb' THEN lower(http_method) ELSE http_method END AS http_method,
       CASE kind WHEN 'cut' THEN '' WHEN 'two_tokens' THEN '' WHEN 'padded_path' THEN request_path || '  '
            ELSE request_path END AS request_path,
       CASE kind WHEN 'cut' THEN '' WHEN 'two_tokens' THEN request_path WHEN 'no_version' THEN '-'
            ELSE http_version END AS http_version,
       CASE kind WHEN 'cut' THEN '' WHEN 'status_099' THEN '099' WHEN 'status_600' THEN '600'
            ELSE CAST(status_code AS VARCHAR) END AS status_str,
       CASE kind WHEN 'cut' THEN '' ELSE coalesce(CAST(response_bytes AS VARCHAR), '-') END AS bytes_str
FROM v"""
_DROPPED = "('cut', 'bad_month', 'two_tokens', 'status_099', 'status_600')"
CLEANED_VARIANTS = f"""WITH {VARIANT_LOGS}
SELECT client_ip, log_ts, http_method, request_path,
       CASE WHEN kind = 'no_version' THEN '-' ELSE http_version END AS http_version,
       status_code, response_bytes, log_date
FROM v WHERE kind NOT IN {_DROPPED}"""
QUALITY_VARIANTS = f"""WITH {VARIANT_LOGS}
SELECT count(*) AS raw_lines, count(*) FILTER (kind <> 'cut') AS matched_lines,
       count(*) FILTER (kind NOT IN {_DROPPED}) AS cleaned_lines,
       round(count(*) FILTER (kind <> 'cut')::DOUBLE / count(*), 6) AS match_rate,
       round(count(*) FILTER (kind NOT IN {_DROPPED})::DOUBLE / count(*), 6) AS parse_rate
FROM v"""

LINE = ("client_ip || ' - - [' || strftime(log_ts, '%d/%b/%Y:%H:%M:%S') || ' +0000] \"' || http_method || ' ' || request_path "
        "|| ' ' || http_version || '\" ' || status_code || ' ' || coalesce(CAST(response_bytes AS VARCHAR), '-')")

ORACLES: dict[str, str] = {
    "log_parse_variants": PARSED_VARIANTS,
    "log_clean_variants": CLEANED_VARIANTS,
    "parse_quality_variants": QUALITY_VARIANTS,
    "sample_lines": f"""WITH {LOGS}
SELECT {ALL_COLS} FROM logs
WHERE CAST('0x' || substr(md5('42:' || {LINE}), 1, 8) AS BIGINT) < {int(0.1 * 2**32)}""",
    "sample_lines_placed": f"""WITH {LOGS_ID},
lines AS (SELECT event_id, CAST(log_date AS VARCHAR) AS day, {LINE} AS value FROM logs),
placed AS (SELECT day, value, CAST(coalesce(sum(octet_length(encode(value)) + 1) OVER (
             PARTITION BY day ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place FROM lines)
SELECT day, place, value FROM placed
WHERE CAST('0x' || substr(md5('42:' || day || ':0:' || place), 1, 8) AS BIGINT) < {int(0.1 * 2**32)}""",
    "registered_view": f"WITH {LOGS} SELECT client_ip, status_code, response_bytes FROM logs",
    "host_avg_bytes_join_nulls": f"""WITH {LOGS_NULL}
SELECT client_ip, count(*) AS total_requests, CAST(sum(response_bytes) AS BIGINT) AS total_bytes,
       round(avg(response_bytes), 6) AS average_bytes
FROM logs GROUP BY client_ip""",
    "host_error_rate_join_nulls": f"""WITH {LOGS_NULL}
SELECT client_ip, count(*) AS total_requests, count(*) FILTER ({ERR}) AS error_requests, {ERR_RATE} AS error_rate
FROM logs GROUP BY client_ip""",
    "session_rows_nulls": _with_sessions(
        1800, "SELECT client_ip, log_ts, prev_ts, gap_secs, is_new_session, session_id FROM with_id", LOGS_NULL),
    "session_ids_nulls": _with_sessions(1800, "SELECT client_ip, log_ts, session_id FROM with_id", LOGS_NULL),
    "metric_upsert_version": f"""WITH {KEYED_RUNS},
both_sides AS (
  SELECT *, 0 AS side, CASE WHEN run % 5 = 4 THEN NULL ELSE '2024-06-01' END AS version FROM runs
  UNION ALL
  SELECT benchmark_id, scale_pct, query, api, run, elapsed_sec / 2, 1,
         CASE run % 5 WHEN 0 THEN '2024-07-01' WHEN 1 THEN '2024-06-01' WHEN 2 THEN '2024-05-01' END FROM runs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY benchmark_id, scale_pct, query, api, run
                                       ORDER BY version DESC NULLS LAST, side DESC) AS rn FROM both_sides)
SELECT benchmark_id, scale_pct, query, api, run, round(elapsed_sec, 6) AS elapsed_sec, version
FROM ranked WHERE rn = 1""",
    # ingest
    "log_parse": PARSED,
    "log_parse_gzip": CLEANED,
    "log_clean": CLEANED,
    "log_clean_strict": f"WITH {LOGS_STRICT} SELECT {ALL_COLS} FROM logs WHERE http_method <> 'FOO'",
    "parse_quality": """
SELECT count(*) AS raw_lines,
       count(*) FILTER (WHERE event_id % 100 <> 0) AS matched_lines,
       count(*) FILTER (WHERE event_id % 100 <> 0) AS cleaned_lines,
       round(CAST(count(*) FILTER (WHERE event_id % 100 <> 0) AS DOUBLE) / CAST(count(*) AS DOUBLE), 6) AS match_rate,
       round(CAST(count(*) FILTER (WHERE event_id % 100 <> 0) AS DOUBLE) / CAST(count(*) AS DOUBLE), 6) AS parse_rate
FROM events""",
    "parse_quality_strict": """
SELECT count(*) AS raw_lines,
       count(*) FILTER (WHERE event_id % 100 <> 0) AS matched_lines,
       count(*) FILTER (WHERE event_id % 100 <> 0 AND user_id % 10 <> 7) AS cleaned_lines,
       round(CAST(count(*) FILTER (WHERE event_id % 100 <> 0) AS DOUBLE) / CAST(count(*) AS DOUBLE), 6) AS match_rate,
       round(CAST(count(*) FILTER (WHERE event_id % 100 <> 0 AND user_id % 10 <> 7) AS DOUBLE)
             / CAST(count(*) AS DOUBLE), 6) AS parse_rate
FROM events""",
    "read_epoch_seconds": f"WITH {LOGS} SELECT client_ip, {EPOCH} AS log_ts, status_code FROM logs",
    "write_roundtrip": CLEANED,
    "write_roundtrip_by_date": CLEANED,
    "write_ignore_roundtrip": CLEANED,
    # error patterns
    "error_rows": f"WITH {LOGS} SELECT {ALL_COLS} FROM logs WHERE {ERR}",
    "error_top_paths": f"WITH {LOGS} SELECT request_path, count(*) AS count FROM logs WHERE {ERR} GROUP BY 1",
    "error_top10_paths": f"WITH {LOGS} " + _top(
        f"SELECT request_path, count(*) AS count FROM logs WHERE {ERR} GROUP BY 1",
        "count", "request_path"),
    "error_status_rates": f"""WITH {LOGS}, per AS (SELECT status_code, count(*) AS count FROM logs GROUP BY 1)
SELECT status_code, count,
       round(CAST(count AS DOUBLE) / CAST((SELECT sum(count) FROM per) AS DOUBLE), 6) AS frequency
FROM per WHERE {ERR}""",
    "error_grouping_sets": f"""WITH {LOGS}, pre AS (
  SELECT request_path, status_code, count(*) AS count FROM logs WHERE {ERR} GROUP BY 1, 2)
SELECT request_path, status_code, CAST(sum(count) AS BIGINT) AS count,
       CASE WHEN GROUPING(status_code) = 1 THEN 'path' ELSE 'status' END AS level
FROM pre GROUP BY GROUPING SETS ((request_path), (status_code))""",
    # per-host traffic
    "host_profile": f"WITH {LOGS} {HOST_PROFILE}",
    "host_requests": f"WITH {LOGS} SELECT client_ip, count(*) AS total_requests FROM logs GROUP BY 1",
    "host_bytes": f"WITH {LOGS} SELECT client_ip, CAST(sum(response_bytes) AS BIGINT) AS total_bytes FROM logs GROUP BY 1",
    "host_avg_bytes": f"WITH {LOGS} SELECT client_ip, round(avg(response_bytes), 6) AS average_bytes FROM logs GROUP BY 1",
    "host_error_rate": f"WITH {LOGS} SELECT client_ip, {ERR_RATE} AS error_rate FROM logs GROUP BY 1",
    "host_distinct_paths": f"WITH {LOGS} SELECT client_ip, count(DISTINCT request_path) AS distinct_endpoints FROM logs GROUP BY 1",
    "host_path_pairs": f"WITH {LOGS} SELECT client_ip, count(DISTINCT request_path) AS distinct_endpoints FROM logs GROUP BY 1",
    "host_avg_bytes_join": f"""WITH {LOGS},
b AS (SELECT client_ip, CAST(sum(response_bytes) AS BIGINT) AS total_bytes,
             count(response_bytes) AS nb FROM logs GROUP BY 1),
n AS (SELECT client_ip, count(*) AS total_requests FROM logs GROUP BY 1)
SELECT b.client_ip, n.total_requests, b.total_bytes,
       round(CAST(b.total_bytes AS DOUBLE) / CAST(nullif(b.nb, 0) AS DOUBLE), 6) AS average_bytes
FROM b JOIN n ON b.client_ip = n.client_ip""",
    "host_error_rate_join": f"""WITH {LOGS},
n AS (SELECT client_ip, count(*) AS total_requests FROM logs GROUP BY 1),
e AS (SELECT client_ip, count(*) AS error_requests FROM logs WHERE {ERR} GROUP BY 1)
SELECT n.client_ip, n.total_requests, coalesce(e.error_requests, 0) AS error_requests,
       round(CAST(coalesce(e.error_requests, 0) AS DOUBLE) / CAST(n.total_requests AS DOUBLE) * 100.0, 6) AS error_rate
FROM n LEFT JOIN e ON n.client_ip = e.client_ip""",
    "host_labels": f"""WITH {LOGS_HOT}, prof AS ({HOST_PROFILE}),
dir AS (SELECT CAST(c_custkey AS VARCHAR) AS client_ip, min(c_name) AS hostname
        FROM customer GROUP BY 1)
SELECT prof.*, coalesce(dir.hostname, prof.client_ip) AS hostname
FROM prof LEFT JOIN dir ON prof.client_ip = dir.client_ip""",
    "top_hosts_requests": f"WITH {LOGS} " + _top(HOST_PROFILE, "total_requests", "client_ip"),
    "top_hosts_error_rate": f"WITH {LOGS} " + _top(HOST_PROFILE, "error_rate", "client_ip"),
    "top_hosts_avg_bytes": f"WITH {LOGS} " + _top(HOST_PROFILE, "average_bytes", "client_ip"),
    "top_hosts_distinct_paths": f"WITH {LOGS} " + _top(HOST_PROFILE, "distinct_endpoints", "client_ip"),
    # temporal
    "hourly_profile": f"WITH {LOGS} {HOURLY}",
    "daily_counts": f"WITH {LOGS} {DAILY}",
    "top_days": f"WITH {LOGS} " + _top(DAILY, "total_requests", "date"),
    "top_hours_volume": f"WITH {LOGS} " + _top(HOURLY, "total_requests", "hour"),
    "top_hours_error_rate": f"WITH {LOGS} " + _top(HOURLY, "error_rate", "hour"),
    # sessions
    "session_gaps": _with_sessions(1800, "SELECT client_ip, log_ts, prev_ts, gap_secs, is_new_session FROM flagged"),
    "session_ids": _with_sessions(1800, "SELECT client_ip, log_ts, session_id FROM with_id"),
    "session_rows_long": _with_sessions(
        LONG_TIMEOUT, "SELECT client_ip, log_ts, prev_ts, gap_secs, is_new_session, session_id FROM with_id"),
    "sessions": _with_sessions(1800, "SELECT client_ip, session_id, request_count, duration_secs FROM sess"),
    "sessions_short_gap": _with_sessions(
        SHORT_TIMEOUT, "SELECT client_ip, session_id, request_count, duration_secs FROM sess"),
    "sessions_long_gap": _with_sessions(
        LONG_TIMEOUT, "SELECT client_ip, session_id, request_count, duration_secs FROM sess"),
    "sessions_per_host": _with_sessions(1800, "SELECT * FROM per_host"),
    "sessions_hot_client": _with_sessions(
        1800, "SELECT client_ip, session_id, request_count, duration_secs FROM sess", LOGS_HOT),
    "sessions_per_host_hot_client": _with_sessions(1800, "SELECT * FROM per_host", LOGS_HOT),
    "host_profile_hot_client": f"WITH {LOGS_HOT} {HOST_PROFILE}",
    "sessions_per_host_long": _with_sessions(LONG_TIMEOUT, "SELECT * FROM per_host"),
    "sessions_nested_flat": _with_sessions(
        LONG_TIMEOUT, "SELECT client_ip, session_id, request_count, duration_secs FROM sess"),
    "sessions_window_fn": _with_sessions(LONG_TIMEOUT, f"""
SELECT client_ip, first_ts AS session_start,
       last_ts + INTERVAL {LONG_TIMEOUT} SECOND AS session_end, request_count, duration_secs
FROM sess"""),
    "sessions_window_fn_default": _with_sessions(1800, """
SELECT client_ip, first_ts AS session_start,
       last_ts + INTERVAL 1800 SECOND AS session_end, request_count, duration_secs
FROM sess"""),
    "top_hosts_sessions": _with_sessions(LONG_TIMEOUT, _top("SELECT * FROM per_host", "session_count", "client_ip")),
    "top_hosts_session_duration": _with_sessions(
        LONG_TIMEOUT, _top("SELECT * FROM per_host", "avg_duration_secs", "client_ip")),
    "top_hosts_session_requests": _with_sessions(
        LONG_TIMEOUT, _top("SELECT * FROM per_host", "avg_requests_per_session", "client_ip")),
    "top_sessions": _with_sessions(LONG_TIMEOUT, _top(
        "SELECT client_ip, session_id, request_count, duration_secs FROM sess",
        "duration_secs", "client_ip, session_id")),
    # SQL surface
    "api_parity": """SELECT * FROM (VALUES ('error_top_paths', true), ('error_status_rates', true),
  ('host_profile', true), ('hourly_profile', true), ('daily_counts', true),
  ('sessions', true), ('sessions_per_host', true)) AS t(family, equal)""",
    "frame_equality_rtol": f"""WITH {LOGS},
per AS (SELECT client_ip, count(*) AS total_requests, avg(response_bytes) AS x FROM logs GROUP BY client_ip),
other AS (SELECT client_ip, total_requests, x * (1 + CASE CAST(client_ip AS BIGINT) % 4 WHEN 0 THEN 4e-6::DOUBLE
                 WHEN 1 THEN 3e-5::DOUBLE ELSE 0 END) AS x FROM per WHERE CAST(client_ip AS BIGINT) % 7 <> 0)
SELECT a.client_ip, a.total_requests, round(a.x, 6) AS left_value, round(b.x, 6) AS right_value, 1::BIGINT AS copies
FROM per a LEFT JOIN other b USING (client_ip)
WHERE b.client_ip IS NULL OR abs(a.x - b.x) > 1e-8::DOUBLE + 1e-5::DOUBLE * abs(b.x)""",
    "frame_equality_ranked": f"""WITH {LOGS_ID},
a AS (SELECT row_number() OVER (ORDER BY x NULLS FIRST) AS r, x FROM (
  SELECT response_bytes / 3.0::DOUBLE AS x FROM logs)),
b AS (SELECT row_number() OVER (ORDER BY x NULLS FIRST) AS r, x FROM (
  SELECT response_bytes / 3.0::DOUBLE * (1 + (event_id % 3) * 6e-6::DOUBLE) AS x FROM logs WHERE event_id % 50 <> 0)),
m AS (SELECT a.x AS l, b.x AS x, b.r IS NULL AS short FROM a LEFT JOIN b USING (r))
SELECT round(l, 6) AS left_value, round(x, 6) AS right_value, false AS left_short, count(*) AS copies FROM m
WHERE short OR (l IS NULL) <> (x IS NULL) OR abs(l - x) > 1e-8::DOUBLE + 1e-5::DOUBLE * abs(x)
GROUP BY ALL""",
    # measurement tables
    "metric_summary": _summary(False),
    "metric_summary_sample": _summary(True),
    "metric_pivot": f"""WITH {MEASUREMENTS}
SELECT query, round(avg(CASE WHEN api = 'F' THEN elapsed_sec END), 6) AS "F",
       round(avg(CASE WHEN api = 'O' THEN elapsed_sec END), 6) AS "O"
FROM measurements GROUP BY query""",
    "metric_scale_trend": f"""WITH {STAGES}
SELECT scale_pct, api,
       round(avg((shuffle_read_bytes + shuffle_write_bytes) / (1024.0 * 1024.0)), 6) AS mean,
       round(stddev_samp((shuffle_read_bytes + shuffle_write_bytes) / (1024.0 * 1024.0)), 6) AS std
FROM stages WHERE query = 'R' GROUP BY scale_pct, api""",
    "metric_union": f"""WITH {MEASUREMENTS}
SELECT benchmark_id, query, api, run, elapsed_sec, 5 AS scale_pct FROM measurements WHERE query = 'A'
UNION ALL
SELECT benchmark_id, query, api, run, elapsed_sec, 10 AS scale_pct FROM measurements WHERE query = 'N'
UNION ALL
SELECT benchmark_id, query, NULL AS api, run, elapsed_sec, 25 AS scale_pct FROM measurements WHERE query = 'R'""",
    "metric_upsert": f"""WITH {KEYED_RUNS},
incoming AS (
  SELECT benchmark_id, scale_pct, query, api, run, elapsed_sec / 2 AS elapsed_sec FROM runs WHERE query = 'P'
  UNION ALL
  SELECT 'rerun-' || benchmark_id, scale_pct, query, api, run, elapsed_sec FROM runs WHERE query = 'F'),
allv AS (SELECT *, 0 AS v FROM runs UNION ALL SELECT *, 1 AS v FROM incoming),
ranked AS (SELECT *, row_number() OVER (PARTITION BY benchmark_id, scale_pct, query, api, run
                                       ORDER BY v DESC, elapsed_sec DESC) AS rn FROM allv)
SELECT benchmark_id, scale_pct, query, api, run, round(elapsed_sec, 6) AS elapsed_sec
FROM ranked WHERE rn = 1""",
    "metric_payload_parts": f"""WITH {MEASUREMENTS}
SELECT benchmark_id, scale_pct, query, api, run, elapsed_sec FROM measurements""",
    "metric_flatten": f"WITH {PAYLOAD_RUNS} SELECT * FROM pruns",
    "metric_flatten_summary": f"""WITH {PAYLOAD_RUNS}
SELECT benchmark_id, scale_pct, query, api, count(*) AS num_runs,
       round(avg(elapsed_sec), 6) AS avg_elapsed_sec,
       round(stddev_pop(elapsed_sec), 6) AS std_elapsed_sec
FROM pruns GROUP BY benchmark_id, scale_pct, query, api""",
    "metric_payload_roundtrip": f"""WITH {PAYLOAD_RUNS},
allv AS (SELECT *, 0.0 AS v FROM (SELECT benchmark_id, scale_pct, query, api, run, 0.0 AS elapsed_sec FROM pruns)
         UNION ALL SELECT *, 1.0 AS v FROM pruns),
ranked AS (SELECT *, row_number() OVER (PARTITION BY benchmark_id, scale_pct, query, api, run
                                       ORDER BY v DESC, elapsed_sec DESC) AS rn FROM allv)
SELECT benchmark_id, scale_pct, query, api, run, elapsed_sec FROM ranked WHERE rn = 1""",
    "metric_delta_totals": f"""WITH {STAGES},
snap AS (SELECT stage_id FROM stages WHERE submitted < TIMESTAMP '1998-01-01 00:00:00'),
new AS (SELECT * FROM stages s WHERE NOT EXISTS (SELECT 1 FROM snap WHERE snap.stage_id = s.stage_id))
SELECT query, api, count(*) AS num_stages,
       CAST(sum(num_tasks) AS BIGINT) AS num_tasks,
       CAST(sum(shuffle_read_bytes) AS BIGINT) AS shuffle_read_bytes,
       CAST(sum(shuffle_write_bytes) AS BIGINT) AS shuffle_write_bytes,
       CAST(sum(disk_bytes_spilled) AS BIGINT) AS disk_bytes_spilled,
       round(sum(executor_deserialize_time) / 1000.0, 6) AS executor_deserialize_time_sec,
       round(sum(executor_cpu_time) / 1000000000.0, 6) AS executor_cpu_time_sec
FROM new GROUP BY query, api""",
}

# Other ways to the same results.
for _k, _of in (("log_parse_ranges", "log_parse_gzip"), ("ingest_incremental", "log_clean"), ("host_profile_from_states", "host_profile"),
                ("top_hosts_paths_threshold", "top_hosts_distinct_paths")):
    ORACLES[_k] = ORACLES[_of]
for _k in ("metric_snapshot_commit", "metric_merge_buckets"):
    ORACLES[_k] = ORACLES["metric_upsert"]

# The SQL surface's keys share the oracles of their DataFrame twins.
for _k in ("error_top_paths", "error_status_rates", "host_profile", "hourly_profile",
           "daily_counts", "sessions", "sessions_per_host", "host_requests", "host_bytes",
           "host_avg_bytes", "host_error_rate", "host_distinct_paths"):
    ORACLES[f"sql_{_k}"] = ORACLES[_k]
