import json

from weblog.operators.metrics import delta_totals
from tools.eventlog import read_event_log, stage_records, task_records


def _acc(name, v):
    return {"ID": 1, "Name": name, "Value": v, "Internal": True}


EVENTS = [
    {"Event": "SparkListenerApplicationStart", "App Name": "x"},
    {"Event": "SparkListenerJobStart", "Job ID": 0, "Stage IDs": [0, 1],
     "Properties": {"spark.jobGroup.id": "famA|0"}},
    {"Event": "SparkListenerStageCompleted", "Stage Info": {
        "Stage ID": 0, "Stage Attempt ID": 0, "Stage Name": "scan", "Number of Tasks": 4,
        "Submission Time": 1000, "Completion Time": 2000, "Accumulables": [
            _acc("internal.metrics.executorCpuTime", 2_000_000_000),
            _acc("internal.metrics.executorDeserializeTime", 500),
            _acc("internal.metrics.shuffle.write.bytesWritten", 1024)]}},
    {"Event": "SparkListenerStageCompleted", "Stage Info": {
        "Stage ID": 1, "Stage Attempt ID": 0, "Stage Name": "agg", "Number of Tasks": 2,
        "Submission Time": 2000, "Completion Time": 2500, "Accumulables": [
            _acc("internal.metrics.shuffle.read.localBytesRead", 1000),
            _acc("internal.metrics.shuffle.read.remoteBytesRead", 24),
            _acc("internal.metrics.diskBytesSpilled", "7")]}},
    {"Event": "SparkListenerTaskEnd", "Stage ID": 1, "Stage Attempt ID": 0,
     "Task End Reason": {"Reason": "Success"}, "Task Info": {"Task ID": 7},
     "Task Metrics": {"Executor Run Time": 12, "Shuffle Read Metrics": {
         "Total Records Read": 30, "Remote Bytes Read": 4, "Local Bytes Read": 6},
         "Input Metrics": {"Records Read": 0}}},
    # a later job lists stage 1 again but skips it: no completion event
    {"Event": "SparkListenerJobStart", "Job ID": 1, "Stage IDs": [1, 2],
     "Properties": {"spark.jobGroup.id": "famB|0"}},
]


def test_stage_records_from_event_log(spark, tmp_path):
    d = tmp_path / "eventlog_v2_app" 
    d.mkdir()
    (d / "events_1_app").write_text("\n".join(json.dumps(e) for e in EVENTS) + "\n")
    st = stage_records(read_event_log(spark, str(tmp_path)))
    rows = {r.stage_id: r for r in st.collect()}
    assert set(rows) == {0, 1}
    assert rows[0].job_group == "famA|0" and rows[1].job_group == "famA|0"
    assert (rows[0].num_tasks, rows[0].shuffle_write_bytes, rows[0].executor_cpu_time) == (4, 1024, 2_000_000_000)
    assert (rows[1].shuffle_read_bytes, rows[1].disk_bytes_spilled) == (1024, 7)
    tot = delta_totals(st, st.where("stage_id = 0"), keys=["job_group"]).collect()[0]
    assert (tot.num_stages, tot.num_tasks, tot.shuffle_read_bytes) == (1, 2, 1024)


def test_task_records(spark, tmp_path):
    d = tmp_path / "eventlog_v2_app"
    d.mkdir()
    (d / "events_1_app").write_text("\n".join(json.dumps(e, separators=(",", ":")) for e in EVENTS) + "\n")
    rows = task_records(read_event_log(spark, str(tmp_path))).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.stage_id, r.task_id, r.succeeded, r.shuffle_records_read, r.shuffle_bytes_read, r.job_group) == \
        (1, 7, True, 30, 10, "famA|0")
