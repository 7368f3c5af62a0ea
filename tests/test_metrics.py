import math

from weblog.operators import metrics as M

COLS = "benchmark_id string, scale_pct int, query string, api string, run int, elapsed_sec double"


def test_upsert_last_write_wins_and_idempotent(spark):
    old = spark.createDataFrame([("id1", 5, "q", "SQL", 1, 3.0), ("id1", 5, "q", "SQL", 2, 4.0)], COLS)
    new = spark.createDataFrame([("id1", 5, "q", "SQL", 2, 9.0), ("id2", 5, "q", "SQL", 1, 1.0)], COLS)
    once = M.upsert(old, new)
    got = sorted((r.benchmark_id, r.run, r.elapsed_sec) for r in once.collect())
    assert got == [("id1", 1, 3.0), ("id1", 2, 9.0), ("id2", 1, 1.0)]
    twice = M.upsert(once, new)
    assert sorted(tuple(r) for r in twice.collect()) == sorted(tuple(r) for r in once.collect())


def test_summary_population_and_sample(spark):
    df = spark.createDataFrame([("b", 5, "q", "A", 1, 2.0), ("b", 5, "q", "A", 2, 4.0),
                                ("b", 5, "q", "B", 1, 5.0)], COLS)
    pop = {r.api: r for r in M.summarize(df, M.SUMMARY_KEY, ["elapsed_sec"]).collect()}
    assert (pop["A"].num_runs, pop["A"].avg_elapsed_sec, pop["A"].std_elapsed_sec) == (2, 3.0, 1.0)
    assert (pop["B"].avg_elapsed_sec, pop["B"].std_elapsed_sec) == (5.0, 0.0)
    smp = {r.api: r for r in M.summarize(df, M.SUMMARY_KEY, ["elapsed_sec"], sample=True).collect()}
    assert math.isclose(smp["A"].std_elapsed_sec, math.sqrt(2)) and smp["B"].std_elapsed_sec is None


def test_union_scales_missing_columns(spark):
    a = spark.createDataFrame([("x", 1.0)], "query string, elapsed_sec double")
    b = spark.createDataFrame([("y",)], "query string")
    rows = sorted(tuple(r) for r in M.union_scales({5: a, 10: b}).collect())
    assert rows == [("x", 1.0, 5), ("y", None, 10)]


def test_payload_flatten_roundtrip(spark, tmp_path):
    from pyspark.sql.types import StructType
    runs = spark.createDataFrame([("id1", 5, "error_pattern_analysis", "SQL", 1, 2.0),
                                  ("id1", 5, "error_pattern_analysis", "SQL", 2, 4.0),
                                  ("id1", 5, "sessionization", "RDD", 1, 7.0)], COLS)
    summ = M.summarize(runs, M.SUMMARY_KEY, ["elapsed_sec"])
    p = M.to_payloads(runs, summ, ["api", "run", "elapsed_sec"],
                      ["num_runs", "avg_elapsed_sec", "std_elapsed_sec"])
    assert p.count() == 1
    p.write.json(str(tmp_path / "a" / "b"))
    back = M.read_payloads(spark, str(tmp_path), "*.json", StructType.fromJson(p.schema.jsonValue()),
                           multi_line=False)
    flat = M.flatten_runs(back)
    assert sorted(tuple(r) for r in flat.collect()) == sorted(tuple(r) for r in runs.collect())
    s = {(r.query, r.api): r for r in M.flatten_summary(back).collect()}
    assert s[("error_pattern_analysis", "SQL")].avg_elapsed_sec == 3.0


def test_delta_totals(spark):
    stages = spark.createDataFrame(
        [(1, 2, 10, 20, 0, 1000, 2_000_000_000), (2, 3, 5, 5, 1, 500, 1_000_000_000)],
        "stage_id int, num_tasks long, shuffle_read_bytes long, shuffle_write_bytes long, "
        "disk_bytes_spilled long, executor_deserialize_time long, executor_cpu_time long")
    snap = spark.createDataFrame([(1,)], "stage_id int")
    r = M.delta_totals(stages, snap).collect()[0]
    assert (r.num_stages, r.num_tasks, r.executor_deserialize_time_sec, r.executor_cpu_time_sec) == (1, 3, 0.5, 1.0)


def test_matrix_fixed_columns(spark):
    df = spark.createDataFrame([("q1", "SQL", 1.0), ("q1", "RDD", 3.0), ("q2", "SQL", 2.0)],
                               "query string, api string, elapsed_sec double")
    m = M.matrix(df, "query", "api", ["RDD", "DataFrame", "SQL"], "elapsed_sec")
    assert m.columns == ["query", "RDD", "DataFrame", "SQL"]


def test_write_merged_refuses_own_input(spark, tmp_path):
    import pytest
    p = str(tmp_path / "merged")
    spark.createDataFrame([("a", 1)], "k string, v int").write.parquet(p)
    with pytest.raises(ValueError):
        M.write_merged(spark.read.parquet(p), p)


def test_payloads_are_built_in_one_shuffle_besides_the_summary(spark):
    runs = spark.createDataFrame([("b1", 5, "q", "A", 1, 2.0), ("b1", 5, "q", "A", 2, 4.0), ("b1", 5, "p", "B", 1, 5.0),
                                  ("b1", 10, "q", "A", 1, 7.0), ("b2", 5, "p", "A", 1, 8.0)], COLS)
    summary = M.summarize(runs.where("benchmark_id = 'b1'"), M.SUMMARY_KEY, ["elapsed_sec"]).unionByName(
        M.summarize(spark.createDataFrame([("b3", 5, "r", "A", 1, 9.0)], COLS), M.SUMMARY_KEY, ["elapsed_sec"]))
    docs = M.to_payloads(runs, summary, ["api", "run", "elapsed_sec"], ["num_runs", "avg_elapsed_sec"], ["q", "p"])
    got = {(d.benchmark_id, d.scale_pct): d for d in docs.collect()}
    assert len(got) == docs.count() == 4
    assert sorted(tuple(r) for r in got["b1", 5].q) == [("A", 1, 2.0), ("A", 2, 4.0)] and [tuple(r) for r in got["b1", 5].p] == [("B", 1, 5.0)]
    stats = {k: {a: tuple(v) for a, v in m.items()} for k, m in got["b1", 5].summary.items()}
    assert stats == {"q": {"A": (2, 3.0)}, "p": {"B": (1, 5.0)}}
    assert got["b2", 5].summary is None and got["b2", 5].q == [] and len(got["b2", 5].p) == 1
    assert got["b3", 5].q is None and got["b3", 5].p is None and got["b3", 5].summary["r"]["A"].num_runs == 1
    # One shuffle for the summary, and one of all rows for the documents.
    plan = M.to_payloads(runs, M.summarize(runs, M.SUMMARY_KEY, ["elapsed_sec"]), ["api", "run", "elapsed_sec"],
                         ["num_runs"], ["q", "p"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
