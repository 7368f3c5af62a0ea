"""Error pattern analysis: which paths fail, and how often each error status occurs."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weblog.functions.exprs import is_error, ratio


def error_rows(logs: DataFrame, status: str = "status_code") -> DataFrame:
    """Rows whose status is an HTTP error (``400 <= s < 600``); pushed into the scan."""
    return logs.where(is_error(status))


def top_paths(logs: DataFrame, path: str = "request_path",
              status: str = "status_code") -> DataFrame:
    """Error count per path: ``(request_path, count)``, most frequent first, ties by path."""
    return (error_rows(logs, status)
            .groupBy(path).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), F.col(path).asc()))


def status_rates(logs: DataFrame, status: str = "status_code") -> DataFrame:
    """Per error status: ``(status_code, count, frequency)``.

    ``frequency`` is the fraction of *all* requests (not of error requests).
    One scan: counts per status over every row (at most a few hundred groups
    after the partial aggregate), the total is a window sum over that small
    result, then the error statuses are kept. No eager count, no join.
    """
    per_status = logs.groupBy(status).agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy())
    return (per_status
            .select(status, "count", ratio(F.col("count"), total).alias("frequency"))
            .where(is_error(status))
            .orderBy(F.col("frequency").desc(), F.col(status).asc()))


def path_status_counts(logs: DataFrame, path: str = "request_path",
                       status: str = "status_code") -> DataFrame:
    """Error count per ``(path, status)``: the shared pre-aggregate of both reports."""
    return (error_rows(logs, status)
            .groupBy(path, status).agg(F.count(F.lit(1)).alias("count")))


def path_status_rollup(logs: DataFrame, path: str = "request_path",
                       status: str = "status_code") -> DataFrame:
    """Both error reports from one pre-aggregate via ``GROUPING SETS``.

    Output ``(request_path, status_code, count, level)``: ``level = 'path'`` rows
    have a null status, ``level = 'status'`` rows a null path.
    """
    pre = path_status_counts(logs, path, status)
    return (pre.groupingSets([[F.col(path)], [F.col(status)]], path, status)
            .agg(F.sum("count").alias("count"),
                 F.grouping_id().alias("_gid"))
            .select(path, status, "count",
                    F.when(F.col("_gid") == 1, F.lit("path"))
                     .otherwise(F.lit("status")).alias("level")))
