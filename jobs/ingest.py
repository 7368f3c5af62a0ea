"""Raw access log (plain or gzip text) -> cleaned, typed Parquet table.

    spark-submit jobs/ingest.py --raw-log-path <logs>/access.log.gz \\
        --output-parquet-path <tables>/access_logs --output-partitions 0 \\
        --partition-by-log-date --input-partitions 2000

One job: read -> (sample) -> parse -> clean -> write. The parse-quality
counts (raw, matched, cleaned lines) are collected by an ``Observation``
during the write itself, not by extra counting passes; lines are parsed once, also
when a shuffle lays out the files. Then the table is read back and
must not be empty. Prints one JSON line with the counts and rates.

With ``--table`` instead of an output path the run is incremental: the table remembers its inputs, and only new or
changed files are parsed (``weblog.sources.ledger``). ``--input-range-bytes`` reads by byte ranges, so that gzip files of
several members are read by several tasks, and samples line by line by place (``weblog.sources.ranges``).
"""
from __future__ import annotations

import argparse
import json
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from weblog.operators.clean import clean_logs  # noqa: E402
from weblog.operators.parse import parse_lines  # noqa: E402
from weblog.operators.quality import observed  # noqa: E402
from weblog.schema import conform  # noqa: E402
from weblog.session import build, clean_scratch, input_bytes, scratch_dir, shuffle_width  # noqa: E402
from weblog.sources import snapshots  # noqa: E402
from weblog.sources.ledger import ingest_new  # noqa: E402
from weblog.sources.logs import committed, verify_written, write_logs  # noqa: E402
from weblog.sources.ranges import read_line_ranges, sample_lines_by_place  # noqa: E402
from weblog.sources.text import read_lines, sample_lines  # noqa: E402


def parse_args(argv=None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    p.add_argument("--raw-log-path", required=True, help="text or .gz file(s) / directory")
    p.add_argument("--output-parquet-path", default=None)
    p.add_argument("--table", default=None, help="folder of an incremental table, instead of an output path")
    p.add_argument("--input-range-bytes", type=int, default=0,
                   help="read byte ranges of about this size (plain files and gzip files of several members)")
    p.add_argument("--output-partitions", type=int, default=0,
                   help="round-robin the rows into n write tasks (0: keep the plan's layout)")
    p.add_argument("--partition-by-log-date", action="store_true",
                   help="lay the table out as log_date=YYYY-MM-DD directories")
    p.add_argument("--rebalance-by-date", action="store_true",
                   help="with --partition-by-log-date: shuffle rows by date first (unordered input)")
    p.add_argument("--strict-http-method", action="store_true",
                   help="drop requests whose method is not a standard HTTP verb")
    p.add_argument("--sample-percent", type=float, default=100.0)
    p.add_argument("--sample-seed", type=int, default=42)
    p.add_argument("--input-partitions", type=int, default=0,
                   help="repartition the lines right after the read (use for .gz input)")
    p.add_argument("--mode", choices=["overwrite", "ignore", "errorifexists"], default="overwrite",
                   help="'ignore' skips an output that was written whole (idempotent rerun); "
                        "'overwrite' forces the run")
    p.add_argument("--master", default=None, help="for local runs; spark-submit sets it otherwise")
    p.add_argument("--profile", choices=["default", "cluster"], default="cluster",
                   help="session settings; 'cluster' sizes shuffles and splits for large inputs")
    args = p.parse_args(argv)
    if bool(args.output_parquet_path) == bool(args.table):
        p.error("name either an output path or a table")
    return args


def sampled_lines(spark, args: argparse.Namespace, paths):
    if args.input_range_bytes:
        lines = read_line_ranges(spark, paths, args.input_range_bytes)
        return sample_lines_by_place(lines, args.sample_percent, args.sample_seed).select("value")
    lines = read_lines(spark, paths, repartition=args.input_partitions or None)
    return sample_lines(lines, args.sample_percent, args.sample_seed)


def run_incremental(spark, args: argparse.Namespace) -> dict:
    """Parse what the table doesn't have yet; the settings that decide its rows are part of the ledger."""
    settings = {"strict": args.strict_http_method, "percent": args.sample_percent, "seed": args.sample_seed}
    if args.sample_percent < 100:
        settings["by"] = "place" if args.input_range_bytes else "row"

    def parse(paths):
        parsed = parse_lines(sampled_lines(spark, args, paths))
        return conform(clean_logs(parsed, strict_http_method=args.strict_http_method))

    done = ingest_new(spark, args.raw_log_path, args.table, parse, settings)
    return {**done, "read_back": snapshots.read(spark, args.table, "logs").count()}


def run(spark, args: argparse.Namespace) -> dict:
    if args.table:
        return run_incremental(spark, args)
    out = args.output_parquet_path
    if args.mode == "ignore" and committed(spark, out):
        return {"skipped": True, "read_back": verify_written(spark, out)}
    # What a broken write left behind has no success marker and is replaced.
    mode = "overwrite" if args.mode == "ignore" else args.mode
    spark.conf.set("spark.sql.shuffle.partitions", str(max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), shuffle_width(input_bytes(spark, args.raw_log_path)))))
    lines = sampled_lines(spark, args, args.raw_log_path)
    strict = args.strict_http_method
    parsed, obs = observed(parse_lines(lines), strict_http_method=strict)
    cleaned = clean_logs(parsed, strict_http_method=strict)
    if args.output_partitions or (args.partition_by_log_date and args.rebalance_by_date):
        # Counts are exact where the observing operator runs in the stage that writes
        # (a lost executor may repeat a map stage). So the one parse writes to
        # scratch without a shuffle, and the shuffle moves the finished table.
        staged = f"{scratch_dir(spark, 'ingest')}/table"
        write_logs(cleaned, staged)
        cleaned = spark.read.parquet(staged)
    write_logs(cleaned, out, partitions=args.output_partitions or None, by_date=args.partition_by_log_date,
               mode=mode, rebalance=args.rebalance_by_date)
    m = obs.get  # filled in by the write that parsed
    raw = m["raw_lines"]
    return {
        "raw_lines": raw,
        "matched_lines": m["matched_lines"],
        "cleaned_lines": m["cleaned_lines"],
        "match_rate": m["matched_lines"] / raw if raw else None,
        "parse_rate": m["cleaned_lines"] / raw if raw else None,
        "read_back": verify_written(spark, out),
    }


def main(argv=None) -> int:
    args = parse_args(argv)
    spark = build(app_name="weblog-ingest", master=args.master, profile=args.profile)
    try:
        print(json.dumps(run(spark, args)))
    finally:
        clean_scratch(spark)
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
