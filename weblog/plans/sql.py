"""SQL surface: one Spark SQL text per query family over a ``{logs}`` relation.

Run with ``spark.sql(text, logs=df)``: the DataFrame is bound as a
parameter, so no temp view name is left behind and concurrent callers do
not collide. CTEs replace the intermediate views. Each function returns the
same columns as its DataFrame counterpart.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ERROR_TOP_PATHS = """
SELECT request_path, count(*) AS count
FROM {logs}
WHERE status_code >= 400 AND status_code < 600
GROUP BY request_path
ORDER BY count DESC, request_path
"""

# The denominator is a window sum over the per-status counts (a few hundred
# rows at most), so the table is scanned once; a scalar subquery would
# compute the per-status aggregate a second time.
ERROR_STATUS_RATES = """
WITH per_status AS (
  SELECT status_code, count(*) AS count,
         try_divide(CAST(count(*) AS DOUBLE), CAST(sum(count(*)) OVER () AS DOUBLE)) AS frequency
  FROM {logs} GROUP BY status_code
)
SELECT status_code, count, frequency
FROM per_status
WHERE status_code >= 400 AND status_code < 600
ORDER BY frequency DESC, status_code
"""

HOST_PROFILE = """
SELECT client_ip,
       count(*) AS total_requests,
       sum(response_bytes) AS total_bytes,
       avg(response_bytes) AS average_bytes,
       try_divide(CAST(count_if(status_code >= 400 AND status_code < 600) AS DOUBLE),
                  CAST(count(*) AS DOUBLE)) * 100.0 AS error_rate,
       count(DISTINCT request_path) AS distinct_endpoints
FROM {logs}
GROUP BY client_ip
"""

HOURLY_PROFILE = """
SELECT hour(log_ts) AS hour,
       count(*) AS total_requests,
       sum(response_bytes) AS total_bytes,
       avg(response_bytes) AS average_bytes,
       try_divide(CAST(count_if(status_code >= 400 AND status_code < 600) AS DOUBLE),
                  CAST(count(*) AS DOUBLE)) * 100.0 AS error_rate
FROM {logs}
GROUP BY hour(log_ts)
"""

DAILY_COUNTS = """
SELECT to_date(log_ts) AS date, count(*) AS total_requests
FROM {logs}
GROUP BY to_date(log_ts)
"""

# Same bucket plan as weblog.operators.sessions: a (client, bucket) summary,
# LAG + running SUM over the summary, then the per-session aggregate.
SESSIONS = """
WITH buckets AS (
  SELECT client_ip,
         floor(unix_timestamp(log_ts) / :width) AS bucket,
         min(unix_timestamp(log_ts)) AS first_s,
         max(unix_timestamp(log_ts)) AS last_s,
         count(*) AS n
  FROM {logs}
  WHERE log_ts IS NOT NULL
  GROUP BY client_ip, floor(unix_timestamp(log_ts) / :width)
),
after_last AS (
  SELECT client_ip, bucket, first_s, last_s, n,
         first_s - LAG(last_s) OVER (PARTITION BY client_ip ORDER BY bucket) AS pause
  FROM buckets
),
counted AS (
  SELECT client_ip, first_s, last_s, n,
         SUM(IF(pause <= :timeout, 0, 1)) OVER (PARTITION BY client_ip ORDER BY bucket
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session_id
  FROM after_last
)
SELECT client_ip, session_id,
       sum(n) AS request_count,
       max(last_s) - min(first_s) AS duration_secs
FROM counted
GROUP BY client_ip, session_id
"""

SESSIONS_PER_HOST = """
SELECT client_ip,
       count(session_id) AS session_count,
       avg(duration_secs) AS avg_duration_secs,
       avg(request_count) AS avg_requests_per_session
FROM {sessions}
GROUP BY client_ip
"""


HOST_REQUESTS = """
SELECT client_ip, count(*) AS total_requests FROM {logs}
GROUP BY client_ip ORDER BY total_requests DESC, client_ip
"""

HOST_BYTES = """
SELECT client_ip, sum(response_bytes) AS total_bytes FROM {logs}
GROUP BY client_ip ORDER BY total_bytes DESC NULLS LAST, client_ip
"""

HOST_AVG_BYTES = """
SELECT client_ip, avg(response_bytes) AS average_bytes FROM {logs}
GROUP BY client_ip ORDER BY average_bytes DESC NULLS LAST, client_ip
"""

HOST_ERROR_RATE = """
SELECT client_ip,
       try_divide(CAST(count_if(status_code >= 400 AND status_code < 600) AS DOUBLE),
                  CAST(count(*) AS DOUBLE)) * 100.0 AS error_rate
FROM {logs}
GROUP BY client_ip ORDER BY error_rate DESC NULLS LAST, client_ip
"""

HOST_DISTINCT_PATHS = """
SELECT client_ip, count(DISTINCT request_path) AS distinct_endpoints FROM {logs}
GROUP BY client_ip ORDER BY distinct_endpoints DESC, client_ip
"""


def host_metrics_naive(spark: SparkSession, logs: DataFrame) -> dict[str, DataFrame]:
    """The five per-host metrics as five separate queries (five scans)."""
    return {
        "requests_per_host": spark.sql(HOST_REQUESTS, logs=logs),
        "bytes_per_host": spark.sql(HOST_BYTES, logs=logs),
        "average_bytes_per_host": spark.sql(HOST_AVG_BYTES, logs=logs),
        "error_rate_per_host": spark.sql(HOST_ERROR_RATE, logs=logs),
        "distinct_endpoints_per_host": spark.sql(HOST_DISTINCT_PATHS, logs=logs),
    }


def error_top_paths(spark: SparkSession, logs: DataFrame) -> DataFrame:
    return spark.sql(ERROR_TOP_PATHS, logs=logs)


def error_status_rates(spark: SparkSession, logs: DataFrame) -> DataFrame:
    return spark.sql(ERROR_STATUS_RATES, logs=logs)


def host_profile(spark: SparkSession, logs: DataFrame) -> DataFrame:
    return spark.sql(HOST_PROFILE, logs=logs)


def hourly_profile(spark: SparkSession, logs: DataFrame) -> DataFrame:
    return spark.sql(HOURLY_PROFILE, logs=logs)


def daily_counts(spark: SparkSession, logs: DataFrame) -> DataFrame:
    return spark.sql(DAILY_COUNTS, logs=logs)


def sessions(spark: SparkSession, logs: DataFrame, timeout: int = 1800) -> DataFrame:
    return spark.sql(SESSIONS, args={"width": max(int(timeout), 1), "timeout": int(timeout)},
                     logs=logs)


def sessions_per_host(spark: SparkSession, session_table: DataFrame) -> DataFrame:
    return spark.sql(SESSIONS_PER_HOST, sessions=session_table)
