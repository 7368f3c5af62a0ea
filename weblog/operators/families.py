"""The five query families as named bundles of lazy results, in two APIs.

``build(spark, logs, family, api="DataFrame" | "SQL", timeout=1800)`` returns a
``dict[str, DataFrame]``; nothing runs until the caller acts on a result. The
``logs`` argument is an access-log DataFrame or a Parquet path. Both APIs plan
to the same physical operators; the SQL texts live in ``weblog.plans.sql``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weblog.functions.exprs import is_error, percent, ratio
from weblog.operators import errors, ranking, temporal, traffic
from weblog.operators import sessions as sess
from weblog.plans import sql as sqlapi
from weblog.session import scratch_dir
from weblog.sources.logs import read_logs

FAMILIES = (
    "error_pattern_analysis",
    "temporal_aggregation",
    "perhost_traffic_profiling",
    "perhost_traffic_profiling_naive",
    "sessionization",
)
APIS = ("DataFrame", "SQL")


def _shared(df: DataFrame, materialize: bool) -> DataFrame:
    """A result that other results are built from: with ``materialize`` it is
    computed once and checkpointed to the session's shared
    ``spark.checkpoint.dir`` (lineage cut; survives lost executors)."""
    if not materialize:
        return df
    scratch_dir(df.sparkSession, "family")  # makes sure a checkpoint folder is set
    return df.checkpoint(eager=True)


def _error_family_once(logs: DataFrame) -> dict[str, DataFrame]:
    """Both error reports from one checkpointed pre-aggregate per (status, path
    of error rows): non-error rows collapse to one row per status."""
    err = is_error("status_code")
    pre = _shared(logs.groupBy("status_code", F.when(err, F.col("request_path")).alias("request_path"))
                  .agg(F.count(F.lit(1)).alias("n")), True)
    paths = (pre.where(is_error("status_code")).groupBy("request_path")
             .agg(F.sum("n").alias("count"))
             .orderBy(F.col("count").desc(), F.col("request_path").asc()))
    per_status = pre.groupBy("status_code").agg(F.sum("n").alias("count"))
    total = F.sum("count").over(Window.partitionBy())
    rates = (per_status.select("status_code", "count", ratio(F.col("count"), total).alias("frequency"))
             .where(is_error("status_code"))
             .orderBy(F.col("frequency").desc(), F.col("status_code").asc()))
    return {"top_endpoints": paths, "error_freq_rate": rates}


def _temporal_family_once(logs: DataFrame) -> dict[str, DataFrame]:
    """Hourly profile and daily counts from one checkpointed (date, hour)
    pre-aggregate; averages are rebuilt from sums and counts, so they are exact."""
    pre = _shared(logs.groupBy(F.to_date("log_ts").alias("date"), F.hour("log_ts").alias("hour"))
                  .agg(F.count(F.lit(1)).alias("n"), F.sum("response_bytes").alias("b"),
                       F.count("response_bytes").alias("nb"),
                       F.count_if(is_error("status_code")).alias("e")), True)
    hourly = pre.groupBy("hour").agg(
        F.sum("n").alias("total_requests"), F.sum("b").alias("total_bytes"),
        F.try_divide(F.sum("b").cast("double"), F.sum("nb").cast("double")).alias("average_bytes"),
        percent(F.sum("e"), F.sum("n")).alias("error_rate"))
    daily = pre.groupBy("date").agg(F.sum("n").alias("total_requests"))
    return {"metrics_per_hour": hourly, "metrics_per_day": daily}


def _dataframe(logs: DataFrame, family: str, timeout: int,
               materialize: bool = False) -> dict[str, DataFrame]:
    if family == "error_pattern_analysis":
        if materialize:
            return _error_family_once(logs)
        return {"top_endpoints": errors.top_paths(logs),
                "error_freq_rate": errors.status_rates(logs)}
    if family == "temporal_aggregation":
        if materialize:
            return _temporal_family_once(logs)
        return {"metrics_per_hour": temporal.hourly_profile(logs),
                "metrics_per_day": temporal.daily_counts(logs)}
    if family == "perhost_traffic_profiling":
        return {"metrics_per_host": traffic.host_profile(logs)}
    if family == "perhost_traffic_profiling_naive":
        k = "client_ip"
        return {
            "requests_per_host": ranking.rank_by(traffic.requests(logs), "total_requests", k),
            "bytes_per_host": ranking.rank_by(traffic.total_bytes(logs), "total_bytes", k),
            "average_bytes_per_host": ranking.rank_by(traffic.avg_bytes(logs), "average_bytes", k),
            "error_rate_per_host": ranking.rank_by(traffic.error_rate(logs), "error_rate", k),
            "distinct_endpoints_per_host": ranking.rank_by(traffic.distinct_paths(logs),
                                                           "distinct_endpoints", k),
        }
    if family == "sessionization":
        s = _shared(sess.sessions(logs, timeout=timeout), materialize)
        return {"sessions": s, "per_ip": sess.per_host(s)}
    raise ValueError(f"unknown family {family!r}; one of {FAMILIES}")


def _sql(spark: SparkSession, logs: DataFrame, family: str, timeout: int,
         materialize: bool = False) -> dict[str, DataFrame]:
    if family == "error_pattern_analysis":
        return {"top_endpoints": sqlapi.error_top_paths(spark, logs),
                "error_freq_rate": sqlapi.error_status_rates(spark, logs)}
    if family == "temporal_aggregation":
        return {"metrics_per_hour": sqlapi.hourly_profile(spark, logs),
                "metrics_per_day": sqlapi.daily_counts(spark, logs)}
    if family == "perhost_traffic_profiling":
        return {"metrics_per_host": sqlapi.host_profile(spark, logs)}
    if family == "perhost_traffic_profiling_naive":
        return sqlapi.host_metrics_naive(spark, logs)
    if family == "sessionization":
        s = _shared(sqlapi.sessions(spark, logs, timeout), materialize)
        return {"sessions": s, "per_ip": sqlapi.sessions_per_host(spark, s)}
    raise ValueError(f"unknown family {family!r}; one of {FAMILIES}")


def build(spark: SparkSession, logs: DataFrame | str, family: str, api: str = "DataFrame",
          timeout: int = sess.DEFAULT_TIMEOUT, materialize: bool = False) -> dict[str, DataFrame]:
    """Named results of one query family over the access-log table.

    Lazy by default. ``materialize=True`` computes what several results share
    once, as a checkpoint in the shared folder: sessions for the per-IP
    statistics; a (date, hour) pre-aggregate for both temporal results; a
    (status, error path) pre-aggregate for both error reports.
    The log table is then scanned once per family instead of once per result.
    The SQL texts of the error and temporal families have no shared part, so
    there the option is refused.
    """
    if materialize and api == "SQL" and family in ("error_pattern_analysis", "temporal_aggregation"):
        raise ValueError(f"materialize=True needs the DataFrame API for {family}")
    df = read_logs(spark, logs) if isinstance(logs, str) else logs
    if api == "DataFrame":
        return _dataframe(df, family, timeout, materialize)
    if api == "SQL":
        return _sql(spark, df, family, timeout, materialize)
    raise ValueError(f"unknown api {api!r}; one of {APIS}")
