"""Benchmark: the reference's five query families plus ingest, on this engine.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Setup (untimed): the ``events`` table is rendered as Combined Log lines.
Timed (median of ``BENCH_RUNS`` runs after one warm-up each, entries in a
seeded random order, ``BENCH_SEED``):

* log_parsing: read lines, parse, clean, write the Parquet table (with the
  parse-quality counts observed in the same job);
* ``sessionization_hot_client/DataFrame``: sessionization of the same log
  with a third of all requests on one client (the skew case);
* ``<family>_materialized/DataFrame`` (error, temporal, sessions): the work the
  family's results share is checkpointed once and read by each result;
* ``<family>/<api>`` for the five query families (error_pattern_analysis,
  temporal_aggregation, perhost_traffic_profiling,
  perhost_traffic_profiling_naive, sessionization) in the DataFrame and SQL
  APIs: every result of the family written to the ``noop`` sink (a full
  execution; ``count()`` would let Catalyst prune the aggregates away).

Prints one JSON line: {"metric", "value" (sum of the medians of log_parsing
and the five families in both APIs; the skew and materialized variants are
listed in "queries" but not summed), "unit", "queries" {name: sec}, "sf",
"rows", "ingest_quality", "stage_metrics"}.
"""
from __future__ import annotations

import json
import os
import random
import re
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from weblog import fixtures as fx  # noqa: E402
from weblog.operators import families as fam  # noqa: E402
from weblog.operators.clean import clean_logs  # noqa: E402
from weblog.operators.parse import parse_lines  # noqa: E402
from weblog.operators.quality import observed  # noqa: E402
from weblog.session import build, scratch_dir  # noqa: E402
from weblog.sources.logs import read_logs, write_logs  # noqa: E402
from tools.eventlog import read_event_log, stage_records  # noqa: E402
from weblog.sources.text import read_lines  # noqa: E402


def _noop(*dfs) -> None:
    for df in dfs:
        df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    event_dir = tempfile.mkdtemp(prefix="weblog-bench-events-")
    spark = build(app_name="weblog-bench", master=f"local[{cpus}]",
                  shuffle_partitions=max(cpus, 1),
                  conf={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g"),
                        "spark.eventLog.enabled": "true",
                        "spark.eventLog.dir": event_dir,
                        "spark.eventLog.compress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="weblog-bench-"))

    raw_dir = scratch_dir(spark, "bench-raw")
    # One raw file per core: the local analogue of a large log read in 128 MB splits.
    fx.raw_lines(spark, sf_dir).repartition(cpus).write.mode("overwrite").text(raw_dir)
    out_dirs: list[str] = []
    quality: dict = {}

    def log_parsing():
        out = scratch_dir(spark, "bench-logs")
        out_dirs.append(out)
        parsed, obs = observed(parse_lines(read_lines(spark, raw_dir)))
        write_logs(clean_logs(parsed), out)
        quality.update(obs.get)  # counted by the write job itself, no extra pass

    log_parsing()  # produce the table the query families read
    table = out_dirs[-1]

    def logs():
        return read_logs(spark, table)

    def family(name: str, api: str):
        return lambda: _noop(*fam.build(spark, logs(), name, api).values())

    families = {"log_parsing": log_parsing}
    for name in fam.FAMILIES:
        for api in fam.APIS:
            families[f"{name}/{api}"] = family(name, api)
    headline = list(families)  # the reference's families in both APIs, plus ingest

    # Skew case: the same log with every third user mapped to one client
    # (a third of all requests on one key).
    hot_table = scratch_dir(spark, "bench-logs-hot")
    write_logs(fx.access_logs(spark, sf_dir, hot_client=True), hot_table, partitions=cpus)
    families["sessionization_hot_client/DataFrame"] = lambda: _noop(
        *fam.build(spark, read_logs(spark, hot_table), "sessionization").values())
    # Shared work computed once (checkpoint in the shared folder) for all results
    # of a family: one scan of the log per family instead of one per result.
    for name in ("error_pattern_analysis", "temporal_aggregation", "sessionization"):
        families[f"{name}_materialized/DataFrame"] = (
            lambda n=name: _noop(*fam.build(spark, logs(), n, materialize=True).values()))
    # Shuffled order (seeded), each entry after its own warm-up: no entry pays
    # the session's start-up cost for the others.
    order = list(families)
    random.Random(int(os.environ.get("BENCH_SEED", "0"))).shuffle(order)
    results: dict[str, float] = {}
    for name in order:
        fn = families[name]
        fn()  # warm-up
        times = []
        for i in range(runs):
            spark.sparkContext.setJobGroup(f"{name}|{i}", name)
            t0 = time.perf_counter()
            fn()
            times.append(time.perf_counter() - t0)
            spark.sparkContext.setJobGroup("other", "other")
        results[name] = round(statistics.median(times), 4)

    results = {name: results[name] for name in families}
    rows = spark.read.parquet(table).count()
    spark.stop()
    sf_match = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "weblog_families_total",
        "value": round(sum(results[k] for k in headline), 4),
        "unit": "sec",
        "queries": results,
        "sf": float(sf_match.group(1)) if sf_match else sf_dir,
        "rows": rows,
        "cpus": cpus,
        "ingest_quality": quality,
        "stage_metrics": _stage_metrics(event_dir, cpus),
    }))


def _stage_metrics(event_dir: str, cpus: int) -> dict:
    """Per timed entry, the mean over its runs of: completed stages, tasks,
    shuffle read / write MiB, spill MiB, executor CPU seconds (from the event log)."""
    from pyspark.sql import functions as F
    spark = build(app_name="weblog-bench-metrics", master=f"local[{cpus}]", shuffle_partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    st = stage_records(read_event_log(spark, event_dir)).where(F.col("job_group").contains("|"))
    mib = 1024.0 * 1024.0
    per_run = st.groupBy("job_group").agg(
        F.count(F.lit(1)).alias("stages"), F.sum("num_tasks").alias("tasks"),
        (F.sum("shuffle_read_bytes") / mib).alias("shuffle_read_mib"),
        (F.sum("shuffle_write_bytes") / mib).alias("shuffle_write_mib"),
        (F.sum("disk_bytes_spilled") / mib).alias("spill_mib"),
        (F.sum("executor_cpu_time") / 1e9).alias("cpu_sec"))
    per_entry = (per_run.withColumn("entry", F.split("job_group", "[|]")[0])
                 .groupBy("entry").agg(*[F.round(F.avg(c), 3).alias(c) for c in
                                         ["stages", "tasks", "shuffle_read_mib", "shuffle_write_mib",
                                          "spill_mib", "cpu_sec"]]))
    out = {r["entry"]: {k: r[k] for k in r.asDict() if k != "entry"} for r in per_entry.collect()}
    spark.stop()
    return out


if __name__ == "__main__":
    main()
