import json

from jobs.merge_results import merge


def _payload(bid, gen, elapsed):
    return {
        "benchmark_id": bid, "scale_pct": 10, "generated_at_utc": gen, "num_runs": 2,
        "error_pattern_analysis": [{"api": "SQL", "run": 1, "elapsed_sec": elapsed},
                                   {"api": "SQL", "run": 2, "elapsed_sec": elapsed + 1}],
        "sessionization": [{"api": "RDD", "run": 1, "elapsed_sec": 3.0}],
        "summary": {"error_pattern_analysis": {"SQL": {"num_runs": 2, "avg_elapsed_sec": elapsed + 0.5,
                                                       "std_elapsed_sec": 0.5}}},
    }


def test_merge_wall_clock_newest_wins_and_idempotent(spark, tmp_path):
    src = tmp_path / "results"
    (src / "pct=10" / "id=a").mkdir(parents=True)
    (src / "pct=10" / "id=b").mkdir(parents=True)
    (src / "pct=10" / "id=a" / "allqueries_wall_clock.json").write_text(
        json.dumps(_payload("x", "2026-01-01T00:00:00", 1.0), indent=2))
    (src / "pct=10" / "id=b" / "allqueries_wall_clock.json").write_text(
        json.dumps(_payload("x", "2026-01-02T00:00:00", 5.0), indent=2))
    (src / "pct=10" / "allqueries_wall_clock_merged.json").write_text("{}")  # ignored by name
    out1 = str(tmp_path / "m1")
    res = merge(spark, "wall_clock", str(src), out1)
    assert (res["records"], res["summary_records"]) == (3, 1)
    recs = {(r.query, r.api, r.run): r.elapsed_sec
            for r in spark.read.parquet(out1 + "/records").collect()}
    assert recs == {("error_pattern_analysis", "SQL", 1): 5.0,
                    ("error_pattern_analysis", "SQL", 2): 6.0,
                    ("sessionization", "RDD", 1): 3.0}
    out2 = str(tmp_path / "m2")
    res2 = merge(spark, "wall_clock", str(src), out2, merged_input=out1)
    assert (res2["records"], res2["summary_records"]) == (3, 1)
    a = sorted(tuple(r) for r in spark.read.parquet(out1 + "/records").collect())
    b = sorted(tuple(r) for r in spark.read.parquet(out2 + "/records").collect())
    assert a == b


def test_merge_stage_metrics(spark, tmp_path):
    src = tmp_path / "r"
    src.mkdir()
    run = {"api": "DataFrame", "run": 1, "num_stages": 7, "num_tasks": 18, "shuffle_read_bytes": 10,
           "shuffle_write_bytes": 10, "disk_bytes_spilled": 0, "executor_deserialize_time_sec": 0.1,
           "executor_cpu_time_sec": 1.5}
    doc = {"benchmark_id": "s", "scale_pct": 5, "generated_at_utc": "t", "num_runs": 1,
           "perhost_traffic_profiling": [run],
           "summary": {"perhost_traffic_profiling": {"DataFrame": {"num_runs": 1, "num_stages_avg": 7.0,
                                                                   "num_stages_std": 0.0}}}}
    (src / "stage_metrics.json").write_text(json.dumps(doc, indent=2))
    res = merge(spark, "stage_metrics", str(src), str(tmp_path / "m"))
    assert (res["records"], res["summary_records"]) == (1, 1)
    r = spark.read.parquet(str(tmp_path / "m") + "/records").collect()[0]
    assert (r.num_tasks, r.executor_cpu_time_sec) == (18, 1.5)
