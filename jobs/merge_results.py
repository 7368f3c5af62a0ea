"""Merge benchmark payload files into run and summary tables (idempotent).

    spark-submit jobs/merge_results.py --kind wall_clock --source-dir results/ \\
        --merged-input merged/v1 --merged-output merged/v2

Reads every payload file of the kind under ``--source-dir`` (any depth; one
pretty-printed JSON document per file), flattens the per-family run arrays and
the summary map, and upserts them into the previous merged tables: one row
per (benchmark_id, scale_pct, query, api, run) for runs, and per
(benchmark_id, scale_pct, query, api) for summaries, the newest
``generated_at_utc`` winning and, of equal ones, the incoming. A damaged payload
file fails the job. Writes ``records/`` and ``summary_records/``
under ``--merged-output``; this must be a new path, never the one read.

With ``--merged-table`` the merge is in place: the folder holds numbered snapshots of both tables, the newest is read,
and the merged tables are published together by one atomic step (``weblog.sources.snapshots``). A failed job leaves the old
tables, and of two jobs at once the later one merges again onto the other's result.
"""
from __future__ import annotations

import argparse
import json
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql.types import (  # noqa: E402
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from weblog.operators import metrics as M  # noqa: E402
from weblog.session import build, clean_scratch  # noqa: E402
from weblog.sources import snapshots  # noqa: E402

# Payload file names and per-kind metric fields.
FILE_NAMES = {"wall_clock": "allqueries_wall_clock.json", "stage_metrics": "stage_metrics.json"}
STAGE_FIELDS = [("num_stages", LongType()), ("num_tasks", LongType()),
                ("shuffle_read_bytes", LongType()), ("shuffle_write_bytes", LongType()),
                ("disk_bytes_spilled", LongType()),
                ("executor_deserialize_time_sec", DoubleType()),
                ("executor_cpu_time_sec", DoubleType())]


def kind_schema(kind: str) -> StructType:
    """Payload schema: run struct and summary stats struct of the kind."""
    run = [StructField("api", StringType()), StructField("run", IntegerType())]
    if kind == "wall_clock":
        run.append(StructField("elapsed_sec", DoubleType()))
        stats = [StructField("num_runs", IntegerType()),
                 StructField("avg_elapsed_sec", DoubleType()),
                 StructField("std_elapsed_sec", DoubleType())]
    elif kind == "stage_metrics":
        run += [StructField(n, t) for n, t in STAGE_FIELDS]
        stats = [StructField("num_runs", IntegerType())]
        for n, _ in STAGE_FIELDS:
            stats += [StructField(f"{n}_avg", DoubleType()), StructField(f"{n}_std", DoubleType())]
    else:
        raise ValueError(f"unknown kind {kind!r}")
    schema = M.payload_schema(StructType(run), StructType(stats))
    return schema.add(StructField("generated_at_utc", StringType()))


def merge(spark, kind: str, source_dir: str, merged_output: str | None = None,
          merged_input: str | None = None, merged_table: str | None = None, tries: int = 5) -> dict:
    if bool(merged_output) == bool(merged_table) or (merged_table and merged_input):
        raise ValueError("name either a merged table, or a merged output with or without an input")
    payloads = M.read_payloads(spark, source_dir, FILE_NAMES[kind], kind_schema(kind))
    carry = ["generated_at_utc"]
    runs = M.flatten_runs(payloads, carry=carry)
    summary = M.flatten_summary(payloads, carry=carry)
    if merged_table:
        for left in reversed(range(tries)):
            base = snapshots.snapshot(spark, merged_table)
            tables = {}
            for name, new, key in (("records", runs, M.RUN_KEY), ("summary_records", summary, M.SUMMARY_KEY)):
                old = snapshots.read(spark, merged_table, name, base) if base.version else None
                tables[name] = (M.upsert(old, new, key, version="generated_at_utc") if old is not None
                                else M.latest(new, key, version="generated_at_utc"))
            try:
                done = snapshots.overwrite(spark, merged_table, tables, base)
            except snapshots.CommitConflict:
                if not left:
                    raise
                continue
            counts = {t: snapshots.read(spark, merged_table, t, done).count() for t in tables}
            return {"kind": kind, **counts, "version": done.version}
    if merged_input:
        runs = M.upsert(spark.read.parquet(f"{merged_input}/records"), runs,
                        M.RUN_KEY, version="generated_at_utc")
        summary = M.upsert(spark.read.parquet(f"{merged_input}/summary_records"), summary,
                           M.SUMMARY_KEY, version="generated_at_utc")
    else:
        # Duplicates inside one batch of payloads: the newest document wins.
        runs = M.latest(runs, M.RUN_KEY, version="generated_at_utc")
        summary = M.latest(summary, M.SUMMARY_KEY, version="generated_at_utc")
    M.write_merged(runs, f"{merged_output}/records")
    M.write_merged(summary, f"{merged_output}/summary_records")
    counts = spark.read.parquet(f"{merged_output}/records").agg(F.count(F.lit(1))).first()[0]
    n_sum = spark.read.parquet(f"{merged_output}/summary_records").agg(F.count(F.lit(1))).first()[0]
    return {"kind": kind, "records": counts, "summary_records": n_sum}


def main(argv=None) -> int:
    p = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    p.add_argument("--kind", choices=sorted(FILE_NAMES), required=True)
    p.add_argument("--source-dir", required=True)
    p.add_argument("--merged-output", default=None)
    p.add_argument("--merged-table", default=None, help="folder of snapshots, merged in place")
    p.add_argument("--merged-input", default=None)
    p.add_argument("--master", default=None)
    a = p.parse_args(argv)
    spark = build(app_name="weblog-merge-results", master=a.master)
    try:
        print(json.dumps(merge(spark, a.kind, a.source_dir, a.merged_output, a.merged_input, a.merged_table)))
    finally:
        clean_scratch(spark)
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
