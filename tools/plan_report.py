"""Write PLANS.md: the physical plan shape of every query key.

    python tools/plan_report.py [sf_dir] > PLANS.md
    python tools/plan_report.py --output-dir DIR --parquet-path LOGS   # one file per result

Per key: shuffle exchanges (with their partitioning), broadcast exchanges,
window and sort operators, generators, and for each file scan its read schema
and pushed filters. Plans are the initial (pre-AQE) physical plans; AQE may
later coalesce partitions or turn a shuffled join into a broadcast at run time.
"""
from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def summarize(plan: str, formatted: str) -> dict:
    shuffles = re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobinPartitioning)\(?([^\n]*?)(?:, \d+\))?, (?:ENSURE_REQUIREMENTS|REPARTITION_BY_COL|REPARTITION_BY_NUM|REBALANCE_PARTITIONS_BY_COL)", plan)
    keys = []
    for kind, rest in shuffles:
        cols = re.sub(r"#\d+L?", "", rest)
        keys.append(f"{kind}({cols})" if kind != "SinglePartition" else "SinglePartition")
    return {
        "shuffles": keys,
        "broadcasts": len(re.findall(r"BroadcastExchange", plan)),
        "windows": len(re.findall(r"\bWindow \[", plan)),
        "joins": re.findall(r"\b(SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin|BroadcastNestedLoopJoin|CartesianProduct)\b", plan),
        "scans": [(re.sub(r"#\d+", "", rs), pf) for rs, pf in zip(
            re.findall(r"ReadSchema: (struct<[^\n]*>)", formatted),
            [m or "[]" for m in re.findall(r"Format: Parquet, Location: [^\n]*?PushedFilters: (\[[^\]]*\])", plan)]
            or ["?"] * 100)],
    }


def write_plan_files(spark, logs_path: str, out_dir: str, benchmark_id: str = "local",
                     scale_pct: int | None = None) -> list[str]:
    """One ``<family>__<api>__<result>.txt`` file per result with its formatted
    physical plan, plus ``run_manifest.json`` (benchmark_id, scale_pct, time)."""
    import datetime as dt
    import json
    from weblog.operators import families as fam
    from tools.inspect_plan import plan_text
    from weblog.sources.logs import read_logs
    os.makedirs(out_dir, exist_ok=True)
    written = []
    for name in fam.FAMILIES:
        for api in fam.APIS:
            for res, df in fam.build(spark, read_logs(spark, logs_path), name, api).items():
                f = os.path.join(out_dir, f"{name}__{api}__{res}.txt")
                with open(f, "w") as fh:
                    fh.write(plan_text(df, "formatted"))
                written.append(f)
    with open(os.path.join(out_dir, "run_manifest.json"), "w") as fh:
        json.dump({"benchmark_id": benchmark_id, "scale_pct": scale_pct,
                   "generated_at_utc": dt.datetime.now(dt.timezone.utc).isoformat(),
                   "files": [os.path.basename(x) for x in written]}, fh, indent=2)
    return written


def main(argv) -> int:
    if "--output-dir" in argv:
        # python tools/plan_report.py --output-dir DIR --parquet-path LOGS [--benchmark-id ID] [--scale-pct N]
        import argparse
        p = argparse.ArgumentParser()
        p.add_argument("--output-dir", required=True)
        p.add_argument("--parquet-path", required=True)
        p.add_argument("--benchmark-id", default="local")
        p.add_argument("--scale-pct", type=int, default=None)
        a = p.parse_args(argv[1:])
        from weblog.session import build
        spark = build(master="local[8]", shuffle_partitions=8)
        spark.sparkContext.setLogLevel("ERROR")
        files = write_plan_files(spark, a.parquet_path, a.output_dir, a.benchmark_id, a.scale_pct)
        print(f"wrote {len(files)} plan files to {a.output_dir}")
        spark.stop()
        return 0
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    from weblog.plans.catalog import QUERIES
    from tools.inspect_plan import plan_text
    from weblog.session import build
    spark = build(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    print("# PLANS — physical plan shape of every query key\n")
    print(f"Generated by `tools/plan_report.py` on `{sf}` (initial plans, before AQE "
          "re-planning; small inputs make the planner pick broadcast joins that a "
          "large input would not). `shuffles` lists each exchange's partitioning.\n")
    print("| key | shuffles | bcast | windows | joins | scans (read schema; pushed filters) |")
    print("|---|---|---|---|---|---|")
    for k, fn in QUERIES.items():
        try:
            df = fn(spark, sf)
            s = summarize(plan_text(df, "simple"), plan_text(df, "formatted"))
        except Exception as e:  # noqa: BLE001
            print(f"| {k} | error: {type(e).__name__} | | | | |")
            continue
        shuffles = "<br>".join(s["shuffles"]) or "–"
        scans = "<br>".join(f"{rs}; {pf}" for rs, pf in s["scans"]) or "–"
        print(f"| {k} | {shuffles} | {s['broadcasts']} | {s['windows']} | "
              f"{', '.join(s['joins']) or '–'} | {scans} |")
    # The families over a Parquet access-log table, as a user runs them.
    from weblog import fixtures as fx
    from weblog.operators import families as fam
    from weblog.session import scratch_dir
    from weblog.sources.logs import read_logs, write_logs
    path = scratch_dir(spark, "plan-logs")
    write_logs(fx.access_logs(spark, sf), path, partitions=8)
    print("\n## The five families over a Parquet access-log table (DataFrame API)\n")
    print("| family / result | shuffles | bcast | windows | joins | scans (read schema; pushed filters) |")
    print("|---|---|---|---|---|---|")
    for name in fam.FAMILIES:
        for res, df in fam.build(spark, read_logs(spark, path), name).items():
            s = summarize(plan_text(df, "simple"), plan_text(df, "formatted"))
            shuffles = "<br>".join(s["shuffles"]) or "–"
            scans = "<br>".join(f"{rs}; {pf}" for rs, pf in s["scans"]) or "–"
            print(f"| {name} / {res} | {shuffles} | {s['broadcasts']} | {s['windows']} | "
                  f"{', '.join(s['joins']) or '–'} | {scans} |")
    # Appendix: the full physical plans of the headline queries.
    from weblog.operators import errors, traffic
    from weblog.operators import sessions as sess
    from weblog.operators.clean import clean_logs
    from weblog.operators.parse import parse_lines
    raw = scratch_dir(spark, "plan-raw")
    fx.raw_lines(spark, sf).write.mode("overwrite").text(raw)
    from weblog.sources.text import read_lines
    headline = {
        "ingest: parse + clean (one stage, filter above the generator)":
            clean_logs(parse_lines(read_lines(spark, raw))),
        "host profile (two exchanges, both after partial aggregation)":
            traffic.host_profile(read_logs(spark, path)),
        "sessions (bucket summary; windows share the client exchange)":
            sess.sessions(read_logs(spark, path)),
        "status rates (one scan; window total over <= a few hundred rows)":
            errors.status_rates(read_logs(spark, path)),
    }
    print("\n## Appendix: physical plans of the headline queries\n")
    for title, df in headline.items():
        text = plan_text(df, "simple").strip()
        text = re.sub(r"#\d+L?", "", text)
        text = re.sub(r"Location: InMemoryFileIndex\([^)]*\)\[[^\]]*\]", "Location: ...", text)
        print(f"### {title}\n\n```\n{text}\n```\n")
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
