"""Print the top-10 reports of a query family over the access-log table.

    spark-submit jobs/report.py --parquet-path <tables>/access_logs \\
        --family perhost_traffic_profiling [--api SQL] [--hosts <tables>/host_directory]

Each report is a ``top_n`` result (at most ``--top`` rows reach the driver);
host rankings show a host name from the optional directory table
(``client_ip, hostname``), falling back to the IP.
"""
from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame  # noqa: E402

from weblog.operators import families as fam  # noqa: E402
from weblog.operators import hosts  # noqa: E402
from weblog.operators.ranking import top_n  # noqa: E402
from weblog.session import build, clean_scratch, scratch_dir  # noqa: E402
from weblog.sources.logs import read_logs  # noqa: E402

# Fixed values: (result name, metric, key columns) of the rankings each family reports.
RANKINGS = {
    "error_pattern_analysis": [("top_endpoints", "count", ["request_path"]),
                               ("error_freq_rate", "frequency", ["status_code"])],
    "temporal_aggregation": [("metrics_per_day", "total_requests", ["date"]),
                             ("metrics_per_hour", "total_requests", ["hour"]),
                             ("metrics_per_hour", "error_rate", ["hour"])],
    "perhost_traffic_profiling": [("metrics_per_host", m, ["client_ip"]) for m in
                                  ("total_requests", "error_rate", "average_bytes",
                                   "distinct_endpoints")],
    "perhost_traffic_profiling_naive": [
        ("requests_per_host", "total_requests", ["client_ip"]),
        ("bytes_per_host", "total_bytes", ["client_ip"]),
        ("average_bytes_per_host", "average_bytes", ["client_ip"]),
        ("error_rate_per_host", "error_rate", ["client_ip"]),
        ("distinct_endpoints_per_host", "distinct_endpoints", ["client_ip"])],
    "sessionization": [("per_ip", "session_count", ["client_ip"]),
                       ("per_ip", "avg_duration_secs", ["client_ip"]),
                       ("per_ip", "avg_requests_per_session", ["client_ip"]),
                       ("sessions", "duration_secs", ["client_ip", "session_id"])],
}


def reports(spark, logs: DataFrame, family: str, api: str = "DataFrame", n: int = 10,
            directory: DataFrame | None = None, timeout: int = 1800) -> list[tuple[str, DataFrame]]:
    """The family's rankings as ``(title, top-n DataFrame)`` pairs.

    A result ranked more than once is computed once (checkpointed to the
    session's ``spark.checkpoint.dir``); the rankings themselves are lazy.
    """
    results = fam.build(spark, logs, family, api, timeout)
    uses: dict[str, int] = {}
    for name, _, _ in RANKINGS[family]:
        uses[name] = uses.get(name, 0) + 1
    for name, n_uses in uses.items():
        if n_uses > 1:
            # Ranked several times: materialise the (aggregated) result once in the
            # shared checkpoint folder instead of recomputing it per ranking.
            scratch_dir(spark, "report")  # makes sure a checkpoint folder is set
            results[name] = results[name].checkpoint(eager=True)
    out = []
    for name, metric, keys in RANKINGS[family]:
        top = top_n(results[name], metric, keys, n)
        if directory is not None and "client_ip" in keys:
            top = top_n(hosts.label_hosts(top, directory), metric, keys, n)
        out.append((f"{family}: {name} by {metric}", top))
    return out


def main(argv=None) -> int:
    p = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    p.add_argument("--parquet-path", required=True)
    p.add_argument("--family", choices=fam.FAMILIES, required=True)
    p.add_argument("--api", choices=fam.APIS, default="DataFrame")
    p.add_argument("--hosts", default=None, help="Parquet table (client_ip, hostname)")
    p.add_argument("--top", type=int, default=10)
    p.add_argument("--timeout", type=int, default=1800, help="session gap in seconds")
    p.add_argument("--master", default=None)
    a = p.parse_args(argv)
    spark = build(app_name="weblog-report", master=a.master)
    try:
        directory = spark.read.parquet(a.hosts) if a.hosts else None
        for title, df in reports(spark, read_logs(spark, a.parquet_path), a.family, a.api,
                                 a.top, directory, a.timeout):
            print(f"\n{title}")
            for row in df.collect():  # at most --top rows
                print("  " + ", ".join(f"{k}={v}" for k, v in row.asDict().items()))
    finally:
        clean_scratch(spark)
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
