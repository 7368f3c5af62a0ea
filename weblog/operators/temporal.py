"""Temporal aggregation: hour-of-day profile and requests per day (UTC)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblog.functions.exprs import is_error, percent


def hourly_profile(logs: DataFrame, ts: str = "log_ts", bytes_col: str = "response_bytes",
                   status: str = "status_code") -> DataFrame:
    """Per hour of day (0-23, over all days): total_requests, total_bytes,
    average_bytes, error_rate (percent)."""
    return logs.groupBy(F.hour(ts).alias("hour")).agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.sum(bytes_col).alias("total_bytes"),
        F.avg(bytes_col).alias("average_bytes"),
        percent(F.count_if(is_error(status)), F.count(F.lit(1))).alias("error_rate"),
    )


def daily_counts(logs: DataFrame, ts: str = "log_ts") -> DataFrame:
    """Requests per calendar date: ``(date, total_requests)``."""
    return logs.groupBy(F.to_date(ts).alias("date")).agg(
        F.count(F.lit(1)).alias("total_requests"))
