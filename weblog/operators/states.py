"""Mergeable per-host states: profiles over days without reading the logs again.

The state of a day holds, per host, counts and sums (requests, bytes and how many rows had them, errors), and the exact set of (host,
path) pairs as a table. Both merge: sums are added, sets united. ``add_logs`` keeps them per day in a snapshot table and rewrites
only the days that new rows belong to, also late ones; ``profile`` merges the days of a range and gives
the rows of ``traffic.host_profile`` over their logs.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblog.functions.exprs import is_error, percent
from weblog.sources import snapshots

SUMS = ["requests", "bytes", "with_bytes", "errors"]


def host_states(logs: DataFrame) -> DataFrame:
    """log_date, client_ip and the sums of each day and host."""
    return logs.groupBy("log_date", "client_ip").agg(
        F.count(F.lit(1)).alias("requests"), F.coalesce(F.sum("response_bytes"), F.lit(0)).alias("bytes"),
        F.count("response_bytes").alias("with_bytes"), F.count_if(is_error("status_code")).alias("errors"))


def host_paths(logs: DataFrame) -> DataFrame:
    """The distinct (log_date, client_ip, request_path) that have a path."""
    return logs.where("request_path IS NOT NULL").select("log_date", "client_ip", "request_path").distinct()


def merged_states(states: DataFrame, *keys: str) -> DataFrame:
    return states.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in SUMS])


def merged_profile(states: DataFrame, paths: DataFrame) -> DataFrame:
    """The columns of ``traffic.host_profile`` from any number of states and path sets of the same rows."""
    host = F.struct(F.col("client_ip").alias("k")).alias("_host")
    sums = merged_states(states.withColumn("_host", host), "_host")
    # Distinct pairs first: a hot host's paths are counted from many tasks.
    n = paths.select(host, "request_path").distinct().groupBy("_host").agg(F.count(F.lit(1)).alias("distinct_endpoints"))
    seen = F.col("with_bytes") > 0
    return sums.join(n, "_host", "left").select(
        F.col("_host.k").alias("client_ip"), F.col("requests").alias("total_requests"),
        F.when(seen, F.col("bytes")).alias("total_bytes"),
        F.when(seen, F.col("bytes").cast("double") / F.col("with_bytes")).alias("average_bytes"),
        percent(F.col("errors"), F.col("requests")).alias("error_rate"),
        F.coalesce("distinct_endpoints", F.lit(0).cast("long")).alias("distinct_endpoints"))


def _part(day: dt.date | None) -> str:
    return f"_day={'none' if day is None else day.isoformat()}"


def add_logs(spark: SparkSession, root: str, logs: DataFrame, base: snapshots.Snapshot | None = None) -> snapshots.Snapshot:
    """Add rows to the stored states: the days they belong to are merged and rewritten, all others keep their files.

    Rows count once per call: give each batch once (``weblog.sources.ledger`` tells which are new).
    """
    base = snapshots.snapshot(spark, root) if base is None else base
    days = {_part(r.log_date) for r in logs.select("log_date").distinct().collect()}  # a row per calendar day
    day = F.coalesce(F.col("log_date").cast("string"), F.lit("none")).alias("_day")
    made = {"states": (host_states(logs), lambda df: merged_states(df, "log_date", "client_ip")),
            "paths": (host_paths(logs), lambda df: df.distinct())}
    dealt = {}
    for table, (new, merge) in made.items():
        if have := sorted(days & base.tables.get(table, {}).keys()):
            new = merge(snapshots.read(spark, root, table, base, have).unionByName(new))
        dealt[table] = (new.select("*", day), "_day")
    return snapshots.commit(spark, root, {}, base, dealt=dealt)


def profile(spark: SparkSession, root: str, date_from: dt.date | None = None, date_to: dt.date | None = None,
            at: snapshots.Snapshot | None = None) -> DataFrame:
    """The host profile of the days from ``date_from`` to ``date_to`` (inclusive); other days aren't opened.

    Rows without a date count only where no range is given.
    """
    at = snapshots.snapshot(spark, root) if at is None else at

    def chosen(table: str) -> list[str]:
        def inside(part: str) -> bool:
            name = part.partition("=")[2]
            if date_from is None and date_to is None:
                return True
            return name != "none" and (date_from is None or name >= date_from.isoformat()) and (
                date_to is None or name <= date_to.isoformat())
        return [p for p in at.tables.get(table, {}) if inside(p)]

    return merged_profile(*[snapshots.read(spark, root, t, at, chosen(t)) for t in ("states", "paths")])
