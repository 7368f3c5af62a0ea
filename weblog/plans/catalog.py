"""The driver's query keys: each builds one lazy result from the test tables.

Every callable takes ``(spark, sf_dir)`` and reads the whole tables under
``sf_dir``. Double columns are rounded to 6 decimals at this outer layer only
(the library keeps full precision) so that results compare across engines.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from weblog import fixtures as fx
from weblog.operators import checks, errors, hosts, matching, metrics, states, ranking, temporal, traffic
from weblog.operators import sessions as sess
from weblog.operators.clean import clean_logs
from weblog.operators.parse import parse_lines
from weblog.operators.quality import parse_quality
from weblog.plans import sql as sqlapi
from weblog.session import default_parallelism, scratch_dir
from weblog.sources import ledger, snapshots
from weblog.sources.logs import read_logs, register_logs, verify_written, write_logs
from weblog.sources.ranges import read_line_ranges, sample_lines_by_place
from weblog.sources.text import read_lines, sample_lines_by_content

Query = Callable[[SparkSession, str], DataFrame]

SHORT_TIMEOUT = 300
LONG_TIMEOUT = 6 * 3600


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[
        F.round(F.col(f.name), digits).alias(f.name)
        if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name)
        for f in df.schema.fields])


def _logs(spark: SparkSession, sf: str) -> DataFrame:
    return fx.access_logs(spark, sf)


# --- ingest: parse, clean, quality, sources and sinks -----------------------

PARSED_COLUMNS = ["line_matched", "client_ip", "log_ts", "http_method", "request_path",
                  "http_version", "status_str", "bytes_str"]


def log_parse(spark, sf):
    return parse_lines(fx.raw_lines(spark, sf)).select(*PARSED_COLUMNS)


def log_clean(spark, sf):
    return clean_logs(parse_lines(fx.raw_lines(spark, sf)))


def log_clean_strict(spark, sf):
    raw = fx.raw_lines(spark, sf, strict_methods=True)
    return clean_logs(parse_lines(raw), strict_http_method=True)


def log_parse_gzip(spark, sf):
    path = scratch_dir(spark, "raw-gzip")
    fx.raw_lines(spark, sf).write.mode("overwrite").option("compression", "gzip").text(path)
    lines = read_lines(spark, path, repartition=default_parallelism(spark))
    return clean_logs(parse_lines(lines))


def parse_quality_key(spark, sf):
    return rounded(parse_quality(parse_lines(fx.raw_lines(spark, sf, malformed=True))))


def parse_quality_strict(spark, sf):
    raw = fx.raw_lines(spark, sf, malformed=True, strict_methods=True)
    return rounded(parse_quality(parse_lines(raw), strict_http_method=True))


def sample_lines_key(spark, sf):
    return clean_logs(parse_lines(sample_lines_by_content(fx.raw_lines(spark, sf), 10.0, seed=42)))


def log_parse_variants(spark, sf):
    return parse_lines(fx.variant_lines(spark, sf)).select(*PARSED_COLUMNS)


def log_clean_variants(spark, sf):
    return clean_logs(parse_lines(fx.variant_lines(spark, sf)))


def parse_quality_variants(spark, sf):
    return rounded(parse_quality(parse_lines(fx.variant_lines(spark, sf))))


def registered_view(spark, sf):
    register_logs(spark, _written(spark, sf), "weblog_registered")
    return spark.sql("SELECT client_ip, status_code, response_bytes FROM weblog_registered")


def _written(spark, sf, **kw) -> str:
    path = scratch_dir(spark, "logs")
    write_logs(_logs(spark, sf), path, **kw)
    verify_written(spark, path)
    return path


def write_roundtrip(spark, sf):
    return read_logs(spark, _written(spark, sf, partitions=4))


def write_roundtrip_by_date(spark, sf):
    return read_logs(spark, _written(spark, sf, by_date=True))


def write_ignore_roundtrip(spark, sf):
    path = _written(spark, sf)
    # A second, different write with mode "ignore" must leave the table as it is.
    write_logs(_logs(spark, sf).where(F.col("status_code") == 500), path, mode="ignore")
    return read_logs(spark, path)


def read_epoch_seconds(spark, sf):
    return read_logs(spark, _written(spark, sf), columns=["client_ip", "log_ts", "status_code"],
                     epoch_seconds=True)


# --- error patterns -----------------------------------------------------------

def error_rows(spark, sf):
    return errors.error_rows(_logs(spark, sf))


def error_top_paths(spark, sf):
    return errors.top_paths(_logs(spark, sf))


def error_top10_paths(spark, sf):
    return ranking.top_n(errors.top_paths(_logs(spark, sf)), "count", "request_path", 10)


def error_status_rates(spark, sf):
    return rounded(errors.status_rates(_logs(spark, sf)))


def error_grouping_sets(spark, sf):
    return errors.path_status_rollup(_logs(spark, sf))


# --- per-host traffic ---------------------------------------------------------

def host_profile(spark, sf):
    return rounded(traffic.host_profile(_logs(spark, sf)))


def _ranked(df: DataFrame, metric: str) -> DataFrame:
    return rounded(ranking.rank_by(df, metric, "client_ip"))


def host_requests(spark, sf):
    return _ranked(traffic.requests(_logs(spark, sf)), "total_requests")


def host_bytes(spark, sf):
    return _ranked(traffic.total_bytes(_logs(spark, sf)), "total_bytes")


def host_avg_bytes(spark, sf):
    return _ranked(traffic.avg_bytes(_logs(spark, sf)), "average_bytes")


def host_error_rate(spark, sf):
    return _ranked(traffic.error_rate(_logs(spark, sf)), "error_rate")


def host_distinct_paths(spark, sf):
    return _ranked(traffic.distinct_paths(_logs(spark, sf)), "distinct_endpoints")


def host_path_pairs(spark, sf):
    return traffic.distinct_pairs(_logs(spark, sf))


def host_avg_bytes_join(spark, sf):
    return rounded(traffic.avg_bytes_by_join(_logs(spark, sf)))


def host_error_rate_join(spark, sf):
    return rounded(traffic.error_rate_by_join(_logs(spark, sf)))


def _null_logs(spark, sf):
    return fx.access_logs(spark, sf, null_clients=True)


def host_avg_bytes_join_nulls(spark, sf):
    return rounded(traffic.avg_bytes_by_join(_null_logs(spark, sf)))


def host_error_rate_join_nulls(spark, sf):
    return rounded(traffic.error_rate_by_join(_null_logs(spark, sf)))


def session_rows_nulls(spark, sf):
    return sess.session_rows(_null_logs(spark, sf).select("client_ip", "log_ts"))


def session_ids_nulls(spark, sf):
    return sess.assign_session_ids(_null_logs(spark, sf).select("client_ip", "log_ts"))


def host_labels(spark, sf):
    # The hot client has no entry in the directory and keeps its address.
    prof = traffic.host_profile(fx.access_logs(spark, sf, hot_client=True))
    return rounded(hosts.label_hosts(prof, fx.host_directory(spark, sf)))


def _top_hosts(metric: str) -> Query:
    def q(spark, sf):
        return rounded(traffic.top_hosts(_logs(spark, sf), metric, 10))
    return q


# --- temporal -----------------------------------------------------------------

def hourly_profile(spark, sf):
    return rounded(temporal.hourly_profile(_logs(spark, sf)))


def daily_counts(spark, sf):
    return temporal.daily_counts(_logs(spark, sf))


def top_days(spark, sf):
    return ranking.top_n(temporal.daily_counts(_logs(spark, sf)), "total_requests", "date", 10)


def top_hours_volume(spark, sf):
    return rounded(ranking.top_n(temporal.hourly_profile(_logs(spark, sf)),
                                 "total_requests", "hour", 10))


def top_hours_error_rate(spark, sf):
    return rounded(ranking.top_n(temporal.hourly_profile(_logs(spark, sf)),
                                 "error_rate", "hour", 10))


# --- sessions -----------------------------------------------------------------

def session_gaps(spark, sf):
    return sess.with_gaps(_logs(spark, sf).select("client_ip", "log_ts"))


def session_ids(spark, sf):
    return sess.assign_session_ids(_logs(spark, sf).select("client_ip", "log_ts"))


def session_rows_long(spark, sf):
    return sess.session_rows(_logs(spark, sf).select("client_ip", "log_ts"), timeout=LONG_TIMEOUT)


def _sessions(timeout: int) -> Query:
    def q(spark, sf):
        return sess.sessions(_logs(spark, sf), timeout=timeout)
    return q


def sessions_hot_client(spark, sf):
    return sess.sessions(fx.access_logs(spark, sf, hot_client=True))


def sessions_per_host_hot_client(spark, sf):
    return rounded(sess.per_host(sess.sessions(fx.access_logs(spark, sf, hot_client=True))))


def host_profile_hot_client(spark, sf):
    return rounded(traffic.host_profile(fx.access_logs(spark, sf, hot_client=True)))


def sessions_per_host(spark, sf):
    return rounded(sess.per_host(sess.sessions(_logs(spark, sf))))


def sessions_per_host_long(spark, sf):
    return rounded(sess.per_host(sess.sessions(_logs(spark, sf), timeout=LONG_TIMEOUT)))


def sessions_nested_flat(spark, sf):
    return sess.flatten_sessions(sess.nested_sessions(sess.sessions(_logs(spark, sf), timeout=LONG_TIMEOUT)))


def sessions_window_fn_default(spark, sf):
    return sess.sessions_by_window(_logs(spark, sf))


def sessions_window_fn(spark, sf):
    return sess.sessions_by_window(_logs(spark, sf), timeout=LONG_TIMEOUT)


def _top_session_hosts(metric: str) -> Query:
    def q(spark, sf):
        per = sess.per_host(sess.sessions(_logs(spark, sf), timeout=LONG_TIMEOUT))
        return rounded(ranking.top_n(per, metric, "client_ip", 10))
    return q


def top_sessions(spark, sf):
    s = sess.sessions(_logs(spark, sf), timeout=LONG_TIMEOUT)
    return ranking.top_n(s, "duration_secs", ["client_ip", "session_id"], 10)


# --- SQL surface parity -------------------------------------------------------

# --- states that are kept and merged ------------------------------------------------

def host_profile_from_states(spark, sf):
    """The profile out of stored day states; the second batch holds late rows of days that are stored already."""
    root = scratch_dir(spark, "host-states")
    logs = fx.access_logs(spark, sf, with_event_id=True)
    for batch in (logs.where("event_id % 3 <> 0"), logs.where("event_id % 3 = 0")):
        states.add_logs(spark, root, batch)
    return rounded(states.profile(spark, root))


def top_hosts_paths_threshold(spark, sf):
    return rounded(traffic.top_hosts_by_paths(_logs(spark, sf), 10))


def ingest_incremental(spark, sf):
    """Raw lines by user group in folders that arrive one after the other; each run parses what is new."""
    root, table = scratch_dir(spark, "raw-batches"), scratch_dir(spark, "ingested")
    lines = fx.raw_lines(spark, sf).withColumn("batch", F.pmod(F.crc32("value"), F.lit(2)))
    parse = lambda paths: clean_logs(parse_lines(read_lines(spark, paths)))
    for turn in range(2):
        lines.where(F.col("batch") == turn).drop("batch").write.text(f"{root}/arrived/batch={turn}")
        ledger.ingest_new(spark, f"{root}/arrived", table, parse)
    ledger.ingest_new(spark, f"{root}/arrived", table, parse)  # nothing is new
    return snapshots.read(spark, table, "logs")


def sample_lines_placed(spark, sf):
    """Lines drawn by seed, day and byte place, from files that are read in ranges of 20 kB."""
    root = scratch_dir(spark, "raw-days")
    logs = fx.access_logs(spark, sf, with_event_id=True).select("event_id", F.col("log_date").cast("string").alias("day"), fx.line_of())
    # Each day is one file, in the order of its events.
    (logs.repartition("day").sortWithinPartitions("day", "event_id").drop("event_id")
     .write.option("maxRecordsPerFile", 0).partitionBy("day").text(f"{root}/days"))
    lines = read_line_ranges(spark, f"{root}/days", range_bytes=20_000)
    day = F.regexp_extract("file", "day=([^/]+)", 1)
    return sample_lines_by_place(lines, 10.0, seed=42, file=day).select(day.alias("day"), "place", "value")


def log_parse_ranges(spark, sf):
    """Gzip files read by the range source."""
    path = scratch_dir(spark, "raw-gzip-ranges")
    fx.raw_lines(spark, sf).write.mode("overwrite").option("compression", "gzip").text(path)
    return clean_logs(parse_lines(read_line_ranges(spark, path, range_bytes=50_000).select("value")))


def api_parity(spark, sf):
    logs = _logs(spark, sf)
    s_df = sess.sessions(logs)
    s_sql = sqlapi.sessions(spark, logs)
    pairs = [
        ("error_top_paths", errors.top_paths(logs), sqlapi.error_top_paths(spark, logs)),
        ("error_status_rates", errors.status_rates(logs), sqlapi.error_status_rates(spark, logs)),
        ("host_profile", traffic.host_profile(logs), sqlapi.host_profile(spark, logs)),
        ("hourly_profile", temporal.hourly_profile(logs), sqlapi.hourly_profile(spark, logs)),
        ("daily_counts", temporal.daily_counts(logs), sqlapi.daily_counts(spark, logs)),
        ("sessions", s_df, s_sql),
        ("sessions_per_host", sess.per_host(s_df), sqlapi.sessions_per_host(spark, s_sql)),
    ]
    out = None
    for name, a, b in pairs:
        r = checks.same_rows(a, b, name)
        out = r if out is None else out.unionByName(r)
    return out


def frame_equality_rtol(spark, sf):
    """Per-host averages against a copy that is off by less or more than the tolerance, lacks hosts or has others."""
    per = (_logs(spark, sf).groupBy("client_ip")
           .agg(F.count(F.lit(1)).alias("total_requests"), F.avg("response_bytes").alias("average_bytes")))
    user = F.col("client_ip").cast("long")
    off = F.when(user % 4 == 0, 4e-6).when(user % 4 == 1, 3e-5).otherwise(0.0)
    other = per.where(user % 7 != 0).withColumn("average_bytes", F.col("average_bytes") * (1 + off))
    found = matching.mismatches(per, other)
    return rounded(found.select("client_ip", "total_requests", F.col("left.average_bytes").alias("left_value"),
                                F.col("right.average_bytes").alias("right_value"), "copies"))


def frame_equality_ranked(spark, sf):
    """Frames of one double column: all rows are one group, matched by rank."""
    logs = fx.access_logs(spark, sf, with_event_id=True)
    left = logs.select((F.col("response_bytes") / 3.0).alias("x"))
    right = logs.where(F.col("event_id") % 50 != 0).select(
        (F.col("response_bytes") / 3.0 * (1 + (F.col("event_id") % 3) * 6e-6)).alias("x"))
    found = matching.mismatches(left, right, stretch=1000)
    return rounded(found.select(F.col("left.x").alias("left_value"), F.col("right.x").alias("right_value"),
                                F.isnull("left").alias("left_short"), "copies")
                   .groupBy("left_value", "right_value", "left_short").agg(F.sum("copies").alias("copies")))


# The SQL surface on its own (each checked against the same oracle as its
# DataFrame twin).

def _sql_key(fn) -> Query:
    def q(spark, sf):
        return rounded(fn(spark, _logs(spark, sf)))
    return q


def sql_sessions_per_host(spark, sf):
    logs = _logs(spark, sf)
    return rounded(sqlapi.sessions_per_host(spark, sqlapi.sessions(spark, logs)))


def _sql_naive(name: str) -> Query:
    def q(spark, sf):
        return rounded(sqlapi.host_metrics_naive(spark, _logs(spark, sf))[name])
    return q


# --- measurement tables -------------------------------------------------------

def metric_summary(spark, sf):
    return rounded(metrics.summarize(fx.measurements(spark, sf), ["scale_pct", "query", "api"],
                                     ["elapsed_sec"]))


def metric_summary_sample(spark, sf):
    return rounded(metrics.summarize(fx.measurements(spark, sf), ["scale_pct", "query", "api"],
                                     ["elapsed_sec"], sample=True))


def metric_pivot(spark, sf):
    return rounded(metrics.matrix(fx.measurements(spark, sf), "query", "api", ["F", "O"],
                                  "elapsed_sec"))


def metric_scale_trend(spark, sf):
    return rounded(metrics.scale_trend(fx.stage_records(spark, sf), "R",
                                       metrics.shuffle_total_mib()))


def metric_union(spark, sf):
    m = fx.measurements(spark, sf).drop("scale_pct")
    return metrics.union_scales({
        5: m.where(F.col("query") == "A"),
        10: m.where(F.col("query") == "N"),
        25: m.where(F.col("query") == "R").drop("api"),
    })


def _upsert_batches(spark, sf):
    runs = fx.keyed_runs(spark, sf)
    updated = (runs.where(F.col("query") == "P")
               .withColumn("elapsed_sec", F.col("elapsed_sec") / 2))
    added = (runs.where(F.col("query") == "F")
             .withColumn("benchmark_id", F.concat(F.lit("rerun-"), F.col("benchmark_id"))))
    return runs, updated.unionByName(added)


def metric_upsert(spark, sf):
    old, new = _upsert_batches(spark, sf)
    return rounded(metrics.upsert(old, new))


def metric_upsert_version(spark, sf):
    """Versions by order key: newer, equal, older, null on one side, null on both."""
    runs = fx.keyed_runs(spark, sf)
    case = F.col("run") % 5
    old = runs.withColumn("version", F.when(case == 4, None).otherwise("2024-06-01"))
    new = (runs.withColumn("elapsed_sec", F.col("elapsed_sec") / 2)
           .withColumn("version", F.when(case == 0, "2024-07-01").when(case == 1, "2024-06-01")
                       .when(case == 2, "2024-05-01")))
    return rounded(metrics.upsert(old, new, version="version"))


PAYLOAD_QUERIES = ("A", "N", "R")
RUN_FIELDS = ["api", "run", "elapsed_sec"]
STATS_FIELDS = ["num_runs", "avg_elapsed_sec", "std_elapsed_sec"]


def _payloads(spark, sf) -> DataFrame:
    runs = fx.payload_runs(spark, sf)
    summary = metrics.summarize(runs, metrics.SUMMARY_KEY, ["elapsed_sec"])
    return metrics.to_payloads(runs, summary, RUN_FIELDS, STATS_FIELDS, PAYLOAD_QUERIES)


def metric_flatten(spark, sf):
    return metrics.flatten_runs(_payloads(spark, sf), PAYLOAD_QUERIES)


def metric_flatten_summary(spark, sf):
    return rounded(metrics.flatten_summary(_payloads(spark, sf)))


def metric_payload_roundtrip(spark, sf):
    root = scratch_dir(spark, "payloads")
    payloads = _payloads(spark, sf)
    payloads.write.mode("overwrite").option("compression", "gzip").json(f"{root}/tree/batch=1")
    schema = payloads.schema
    back = metrics.read_payloads(spark, f"{root}/tree", "*.json.gz", schema, multi_line=False)
    flat = metrics.flatten_runs(back, PAYLOAD_QUERIES)
    # The merged table already holds every run with a stale value; the payload wins.
    stale = fx.payload_runs(spark, sf).withColumn("elapsed_sec", F.lit(0.0))
    merged = metrics.upsert(stale, flat)
    metrics.write_merged(merged, f"{root}/merged")
    return spark.read.parquet(f"{root}/merged")


def metric_snapshot_commit(spark, sf):
    """A merged table over three commits: the base, one that fails midway, and the merge onto what readers still see."""
    root = scratch_dir(spark, "merged-table")
    old, new = _upsert_batches(spark, sf)
    snapshots.overwrite(spark, root, {"records": old}, snapshots.snapshot(spark, root))
    broken = new.withColumn("elapsed_sec", F.when(F.col("query") == "P", F.raise_error(F.lit("broken")).cast("double")))
    try:
        snapshots.overwrite(spark, root, {"records": broken}, snapshots.snapshot(spark, root))
    except Exception as e:  # noqa: BLE001
        if "broken" not in str(e):
            raise
    base = snapshots.snapshot(spark, root)
    snapshots.overwrite(spark, root, {"records": metrics.upsert(snapshots.read(spark, root, "records", base), new)}, base)
    return rounded(snapshots.read(spark, root, "records"))


def metric_merge_buckets(spark, sf):
    """The same merge bucket by bucket: the second batch rewrites only the buckets of its keys."""
    root = scratch_dir(spark, "bucketed-table")
    for batch in _upsert_batches(spark, sf):
        metrics.merge_buckets(spark, root, "records", batch, buckets=16)
    return rounded(snapshots.read(spark, root, "records"))


def metric_payload_parts(spark, sf):
    """Benchmarks of thousands of runs as documents of 500 each, written, read back, checked and flattened."""
    runs = fx.measurements(spark, sf)
    summary = metrics.summarize(runs, metrics.SUMMARY_KEY, ["elapsed_sec"])
    parts = metrics.to_payload_parts(runs, summary, RUN_FIELDS, STATS_FIELDS, PAYLOAD_QUERIES, part_runs=500)
    root = scratch_dir(spark, "payload-parts")
    parts.write.mode("overwrite").json(f"{root}/tree")
    back = metrics.read_payloads(spark, f"{root}/tree", "*.json", parts.schema, multi_line=False)
    return metrics.flatten_runs(metrics.whole_parts(back, PAYLOAD_QUERIES), PAYLOAD_QUERIES)


def metric_delta_totals(spark, sf):
    stages = fx.stage_records(spark, sf)
    cutoff = F.lit("1998-01-01 00:00:00").cast(stages.schema["submitted"].dataType)
    snapshot = stages.where(F.col("submitted") < cutoff)
    return rounded(metrics.delta_totals(stages, snapshot, keys=["query", "api"]))


QUERIES: dict[str, Query] = {
    # ingest
    "log_parse": log_parse,
    "log_parse_gzip": log_parse_gzip,
    "log_clean": log_clean,
    "log_clean_strict": log_clean_strict,
    "parse_quality": parse_quality_key,
    "parse_quality_strict": parse_quality_strict,
    "sample_lines": sample_lines_key,
    "sample_lines_placed": sample_lines_placed,
    "log_parse_ranges": log_parse_ranges,
    "ingest_incremental": ingest_incremental,
    "host_profile_from_states": host_profile_from_states,
    "top_hosts_paths_threshold": top_hosts_paths_threshold,
    "log_parse_variants": log_parse_variants,
    "log_clean_variants": log_clean_variants,
    "parse_quality_variants": parse_quality_variants,
    "registered_view": registered_view,
    "read_epoch_seconds": read_epoch_seconds,
    "write_roundtrip": write_roundtrip,
    "write_roundtrip_by_date": write_roundtrip_by_date,
    "write_ignore_roundtrip": write_ignore_roundtrip,
    # error patterns
    "error_rows": error_rows,
    "error_top_paths": error_top_paths,
    "error_top10_paths": error_top10_paths,
    "error_status_rates": error_status_rates,
    "error_grouping_sets": error_grouping_sets,
    # per-host traffic
    "host_profile": host_profile,
    "host_requests": host_requests,
    "host_bytes": host_bytes,
    "host_avg_bytes": host_avg_bytes,
    "host_error_rate": host_error_rate,
    "host_distinct_paths": host_distinct_paths,
    "host_path_pairs": host_path_pairs,
    "host_avg_bytes_join": host_avg_bytes_join,
    "host_error_rate_join": host_error_rate_join,
    "host_labels": host_labels,
    "host_avg_bytes_join_nulls": host_avg_bytes_join_nulls,
    "host_error_rate_join_nulls": host_error_rate_join_nulls,
    "top_hosts_requests": _top_hosts("total_requests"),
    "top_hosts_error_rate": _top_hosts("error_rate"),
    "top_hosts_avg_bytes": _top_hosts("average_bytes"),
    "top_hosts_distinct_paths": _top_hosts("distinct_endpoints"),
    # temporal
    "hourly_profile": hourly_profile,
    "daily_counts": daily_counts,
    "top_days": top_days,
    "top_hours_volume": top_hours_volume,
    "top_hours_error_rate": top_hours_error_rate,
    # sessions
    "session_gaps": session_gaps,
    "session_ids": session_ids,
    "session_rows_long": session_rows_long,
    "session_rows_nulls": session_rows_nulls,
    "session_ids_nulls": session_ids_nulls,
    "sessions": _sessions(sess.DEFAULT_TIMEOUT),
    "sessions_short_gap": _sessions(SHORT_TIMEOUT),
    "sessions_long_gap": _sessions(LONG_TIMEOUT),
    "sessions_per_host": sessions_per_host,
    "sessions_hot_client": sessions_hot_client,
    "sessions_per_host_hot_client": sessions_per_host_hot_client,
    "host_profile_hot_client": host_profile_hot_client,
    "sessions_per_host_long": sessions_per_host_long,
    "sessions_nested_flat": sessions_nested_flat,
    "sessions_window_fn": sessions_window_fn,
    "sessions_window_fn_default": sessions_window_fn_default,
    "top_hosts_sessions": _top_session_hosts("session_count"),
    "top_hosts_session_duration": _top_session_hosts("avg_duration_secs"),
    "top_hosts_session_requests": _top_session_hosts("avg_requests_per_session"),
    "top_sessions": top_sessions,
    # SQL surface
    "api_parity": api_parity,
    "frame_equality_rtol": frame_equality_rtol,
    "frame_equality_ranked": frame_equality_ranked,
    "sql_error_top_paths": _sql_key(sqlapi.error_top_paths),
    "sql_error_status_rates": _sql_key(sqlapi.error_status_rates),
    "sql_host_profile": _sql_key(sqlapi.host_profile),
    "sql_hourly_profile": _sql_key(sqlapi.hourly_profile),
    "sql_daily_counts": _sql_key(sqlapi.daily_counts),
    "sql_sessions": _sql_key(sqlapi.sessions),
    "sql_sessions_per_host": sql_sessions_per_host,
    "sql_host_requests": _sql_naive("requests_per_host"),
    "sql_host_bytes": _sql_naive("bytes_per_host"),
    "sql_host_avg_bytes": _sql_naive("average_bytes_per_host"),
    "sql_host_error_rate": _sql_naive("error_rate_per_host"),
    "sql_host_distinct_paths": _sql_naive("distinct_endpoints_per_host"),
    # measurement tables
    "metric_summary": metric_summary,
    "metric_summary_sample": metric_summary_sample,
    "metric_pivot": metric_pivot,
    "metric_scale_trend": metric_scale_trend,
    "metric_union": metric_union,
    "metric_upsert": metric_upsert,
    "metric_upsert_version": metric_upsert_version,
    "metric_snapshot_commit": metric_snapshot_commit,
    "metric_merge_buckets": metric_merge_buckets,
    "metric_payload_parts": metric_payload_parts,
    "metric_flatten": metric_flatten,
    "metric_flatten_summary": metric_flatten_summary,
    "metric_payload_roundtrip": metric_payload_roundtrip,
    "metric_delta_totals": metric_delta_totals,
}
