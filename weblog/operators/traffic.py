"""Per-host traffic profiling.

``host_profile`` computes all five metrics in one aggregation (one scan, the
distinct count handled by Spark's two-level distinct rewrite with partial
aggregation before each exchange). The single-metric functions exist for
callers that want one metric; asked together they would scan five times.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblog.functions.exprs import is_error, percent
from weblog.operators.ranking import rank_by, top_n
from weblog.session import scratch_dir


def _bytes(col: str, null_as_zero: bool) -> Column:
    c = F.col(col)
    return F.coalesce(c, F.lit(0)) if null_as_zero else c


def _error_rate(status: str) -> Column:
    return percent(F.count_if(is_error(status)), F.count(F.lit(1)))


def host_profile(logs: DataFrame, key: str = "client_ip", bytes_col: str = "response_bytes",
                 status: str = "status_code", path: str = "request_path",
                 null_bytes_as_zero: bool = False) -> DataFrame:
    """One row per host: total_requests, total_bytes, average_bytes,
    error_rate (percent), distinct_endpoints.

    Null bytes are ignored by sum and average (SQL semantics); a host whose
    bytes are all null has null total and average. ``null_bytes_as_zero``
    counts a null as 0 in both (total 0, average over all requests).
    """
    b = _bytes(bytes_col, null_bytes_as_zero)
    return logs.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.sum(b).alias("total_bytes"),
        F.avg(b).alias("average_bytes"),
        _error_rate(status).alias("error_rate"),
        F.count_distinct(path).alias("distinct_endpoints"),
    )


def requests(logs: DataFrame, key: str = "client_ip") -> DataFrame:
    return logs.groupBy(key).agg(F.count(F.lit(1)).alias("total_requests"))


def total_bytes(logs: DataFrame, key: str = "client_ip", bytes_col: str = "response_bytes",
                null_bytes_as_zero: bool = False) -> DataFrame:
    return logs.groupBy(key).agg(F.sum(_bytes(bytes_col, null_bytes_as_zero)).alias("total_bytes"))


def avg_bytes(logs: DataFrame, key: str = "client_ip", bytes_col: str = "response_bytes",
              null_bytes_as_zero: bool = False) -> DataFrame:
    return logs.groupBy(key).agg(F.avg(_bytes(bytes_col, null_bytes_as_zero)).alias("average_bytes"))


def error_rate(logs: DataFrame, key: str = "client_ip", status: str = "status_code") -> DataFrame:
    return logs.groupBy(key).agg(_error_rate(status).alias("error_rate"))


def distinct_paths(logs: DataFrame, key: str = "client_ip",
                   path: str = "request_path") -> DataFrame:
    return logs.groupBy(key).agg(F.count_distinct(path).alias("distinct_endpoints"))


def top_hosts(logs: DataFrame, metric: str, n: int = 10, key: str = "client_ip",
              bytes_col: str = "response_bytes", status: str = "status_code",
              path: str = "request_path") -> DataFrame:
    """The ``host_profile`` rows of the n hosts that rank first by a metric.

    Only a ranking by distinct endpoints needs that count for every host. For the
    others, hosts are ranked by one light aggregate, and paths are counted for the n
    hosts alone (their rows come by a join with n rows).
    """
    if metric == "distinct_endpoints":
        return top_n(host_profile(logs, key, bytes_col, status, path), metric, key, n)
    light = logs.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_requests"), F.sum(bytes_col).alias("total_bytes"),
        F.avg(bytes_col).alias("average_bytes"), _error_rate(status).alias("error_rate"))
    first = top_n(light, metric, key, n)
    theirs = logs.select(F.col(key).alias("_host"), F.col(path).alias("_path"))
    paths = (theirs.join(first.select(key), F.col("_host").eqNullSafe(F.col(key)), "left_semi")
             .groupBy("_host").agg(F.count_distinct("_path").alias("distinct_endpoints")))
    both = first.join(paths, F.col(key).eqNullSafe(F.col("_host"))).drop("_host")
    return rank_by(both, metric, key)


def top_hosts_by_paths(logs: DataFrame, n: int = 10, key: str = "client_ip", bytes_col: str = "response_bytes",
                       status: str = "status_code", path: str = "request_path", grow: int = 8) -> DataFrame:
    """``top_hosts`` by distinct endpoints without counting every host's paths (a threshold algorithm).

    A host has at most as many distinct paths as requests with a path. Hosts are taken in falling order of that
    bound, ``grow`` times as many in each round; their paths are counted, and the search ends when the n-th best count
    reaches the least bound taken: no other host can come before it. Per round the logs are read once and only the new hosts'
    (host, path) pairs are shuffled. Runs jobs while it is built: a round tells the driver two numbers, and n
    hosts in the end. If the bounds don't help (equal for all hosts), the rounds grow to all hosts.
    """
    spark = logs.sparkSession
    rows = logs.withColumn("_host", F.struct(F.col(key).alias("k")))
    staged = f"{scratch_dir(spark, 'top-hosts')}/bounds"
    rows.groupBy("_host").agg(F.count(path).alias("_bound")).write.parquet(staged)
    bounds = spark.read.parquet(staged)
    best, above, take = None, None, grow * n
    while True:
        cut = bounds.orderBy(F.desc("_bound")).limit(take).agg(F.min("_bound").alias("low"), F.count(F.lit(1)).alias("n")).first()
        low = cut.low if cut.n == take else -1  # all hosts are taken
        new = bounds.where((F.col("_bound") >= low) & (F.lit(True) if above is None else F.col("_bound") < above))
        found = (rows.select("_host", path).join(new.select("_host"), "_host", "left_semi")
                 .groupBy("_host").agg(F.count_distinct(path).alias("distinct_endpoints")))
        found = found.withColumn(key, F.col("_host.k"))
        kept = top_n(found if best is None else found.unionByName(best), "distinct_endpoints", key, n).collect()  # n rows
        best = spark.createDataFrame(kept, found.schema)
        if low < 0 or (len(kept) == n and min(r.distinct_endpoints for r in kept) >= low):
            break
        above, take = low, take * grow
    light = rows.join(best.select("_host"), "_host", "left_semi").groupBy("_host").agg(
        F.count(F.lit(1)).alias("total_requests"), F.sum(bytes_col).alias("total_bytes"),
        F.avg(bytes_col).alias("average_bytes"), _error_rate(status).alias("error_rate"))
    both = best.join(light, "_host").select(
        key, "total_requests", "total_bytes", "average_bytes", "error_rate", "distinct_endpoints")
    return rank_by(both, "distinct_endpoints", key)


def distinct_pairs(logs: DataFrame, key: str = "client_ip",
                   path: str = "request_path") -> DataFrame:
    """Distinct paths per host as an explicit two-step plan: distinct pairs, then count.

    Rows with a null path are not counted, as in ``count_distinct``.
    """
    return (logs.where(F.col(path).isNotNull()).select(key, path).distinct()
            .groupBy(key).agg(F.count(F.lit(1)).alias("distinct_endpoints")))


def _by_host(logs: DataFrame, key: str):
    """Group by the key wrapped in a struct: structs of nulls are equal, so joins on it keep a null host."""
    return logs.groupBy(F.struct(F.col(key).alias("k")).alias("_host"))


def avg_bytes_by_join(logs: DataFrame, key: str = "client_ip",
                      bytes_col: str = "response_bytes") -> DataFrame:
    """Average bytes as ``bytes ⋈ requests``: both sides are aggregates hashed
    on the key, so the join reuses their partitioning (no extra exchange)."""
    b = _by_host(logs, key).agg(F.sum(bytes_col).alias("total_bytes"),
                                F.count(bytes_col).alias("_n_bytes"))
    n = _by_host(logs, key).agg(F.count(F.lit(1)).alias("total_requests"))
    return (b.join(n, "_host", "inner")
            .select(F.col("_host.k").alias(key), "total_requests", "total_bytes",
                    F.try_divide(F.col("total_bytes").cast("double"),
                                 F.col("_n_bytes").cast("double")).alias("average_bytes")))


def error_rate_by_join(logs: DataFrame, key: str = "client_ip",
                       status: str = "status_code") -> DataFrame:
    """Error rate as ``requests ⟕ error counts`` with a default of 0 errors."""
    n = _by_host(logs, key).agg(F.count(F.lit(1)).alias("total_requests"))
    e = _by_host(logs.where(is_error(status)), key).agg(F.count(F.lit(1)).alias("error_requests"))
    j = n.join(e, "_host", "left")
    errs = F.coalesce(F.col("error_requests"), F.lit(0))
    return j.select(F.col("_host.k").alias(key), "total_requests", errs.alias("error_requests"),
                    percent(errs, F.col("total_requests")).alias("error_rate"))
