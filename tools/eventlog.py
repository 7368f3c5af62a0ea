"""Spark event logs as a source of stage records (no UI server needed).

The reference scraped stage metrics from the Spark UI's REST interface. The
same records are in the event log Spark writes when ``spark.eventLog.enabled``
is set: one JSON object per line. This module reads those lines as a text
table, parses only the two event types it needs with explicit schemas, and
returns one row per completed stage attempt, tagged with the job group of the
job that ran it. Skipped stages never complete, so they are not counted.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
)

_ACCUMULABLES = ArrayType(StructType([
    StructField("Name", StringType()),
    StructField("Value", StringType()),
]))
_STAGE_COMPLETED = StructType([
    StructField("Stage Info", StructType([
        StructField("Stage ID", LongType()),
        StructField("Stage Attempt ID", LongType()),
        StructField("Stage Name", StringType()),
        StructField("Number of Tasks", LongType()),
        StructField("Submission Time", LongType()),
        StructField("Completion Time", LongType()),
        StructField("Failure Reason", StringType()),
        StructField("Accumulables", _ACCUMULABLES),
    ])),
])
_JOB_START = StructType([
    StructField("Job ID", LongType()),
    StructField("Stage IDs", ArrayType(LongType())),
    StructField("Properties", MapType(StringType(), StringType())),
])

# Task metric accumulators summed per stage (names as Spark writes them).
STAGE_METRICS = {
    "shuffle_read_bytes": ("internal.metrics.shuffle.read.remoteBytesRead",
                           "internal.metrics.shuffle.read.localBytesRead"),
    "shuffle_write_bytes": ("internal.metrics.shuffle.write.bytesWritten",),
    "disk_bytes_spilled": ("internal.metrics.diskBytesSpilled",),
    "executor_deserialize_time": ("internal.metrics.executorDeserializeTime",),  # ms
    "executor_cpu_time": ("internal.metrics.executorCpuTime",),  # ns
}


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """Event-log lines (``value``) of every file under ``path``, recursively.

    Expects uncompressed logs (``spark.eventLog.compress=false``).
    """
    return spark.read.option("recursiveFileLookup", True).text(path)


def _event(name: str) -> Column:
    # Spark writes the event type first; a prefix match avoids parsing other events.
    return F.col("value").rlike(r'^\{\s*"Event"\s*:\s*"' + name + '"')


def _accumulated(accs: Column, names: tuple[str, ...]) -> Column:
    picked = F.filter(accs, lambda a: a["Name"].isin(*names))
    return F.aggregate(picked, F.lit(0).cast("long"),
                       lambda acc, a: acc + F.coalesce(a["Value"].try_cast("long"), F.lit(0).cast("long")))


def stage_records(events: DataFrame, group_property: str = "spark.jobGroup.id") -> DataFrame:
    """One row per completed stage attempt: stage_id, attempt, job_group,
    stage_name, num_tasks, submitted / completed (epoch ms), failed, and the
    counters of ``STAGE_METRICS`` (times in ms and ns, as Spark reports them)."""
    info = (events.where(_event("SparkListenerStageCompleted"))
            .select(F.from_json("value", _STAGE_COMPLETED)["Stage Info"].alias("s")))
    stages = info.select(
        F.col("s")["Stage ID"].alias("stage_id"),
        F.col("s")["Stage Attempt ID"].alias("attempt"),
        F.col("s")["Stage Name"].alias("stage_name"),
        F.col("s")["Number of Tasks"].alias("num_tasks"),
        F.col("s")["Submission Time"].alias("submitted"),
        F.col("s")["Completion Time"].alias("completed"),
        F.col("s")["Failure Reason"].isNotNull().alias("failed"),
        *[_accumulated(F.col("s")["Accumulables"], names).alias(out)
          for out, names in STAGE_METRICS.items()],
    )
    # A stage belongs to the first job that listed it (later jobs reuse it).
    return stages.join(_stage_owner(events, group_property), "stage_id", "left")


_TASK_END = StructType([
    StructField("Stage ID", LongType()),
    StructField("Stage Attempt ID", LongType()),
    StructField("Task End Reason", StructType([StructField("Reason", StringType())])),
    StructField("Task Info", StructType([StructField("Task ID", LongType())])),
    StructField("Task Metrics", StructType([
        StructField("Executor Run Time", LongType()),
        StructField("Shuffle Read Metrics", StructType([
            StructField("Total Records Read", LongType()),
            StructField("Remote Bytes Read", LongType()),
            StructField("Local Bytes Read", LongType()),
        ])),
        StructField("Input Metrics", StructType([StructField("Records Read", LongType())])),
    ])),
])


def task_records(events: DataFrame, group_property: str = "spark.jobGroup.id") -> DataFrame:
    """One row per finished task: stage_id, attempt, task_id, job_group, succeeded,
    run_time_ms, shuffle_records_read, shuffle_bytes_read, input_records."""
    t = (events.where(_event("SparkListenerTaskEnd"))
         .select(F.from_json("value", _TASK_END).alias("t")))
    m = F.col("t")["Task Metrics"]
    srm = m["Shuffle Read Metrics"]
    tasks = t.select(
        F.col("t")["Stage ID"].alias("stage_id"),
        F.col("t")["Stage Attempt ID"].alias("attempt"),
        F.col("t")["Task Info"]["Task ID"].alias("task_id"),
        (F.col("t")["Task End Reason"]["Reason"] == "Success").alias("succeeded"),
        m["Executor Run Time"].alias("run_time_ms"),
        srm["Total Records Read"].alias("shuffle_records_read"),
        (srm["Remote Bytes Read"] + srm["Local Bytes Read"]).alias("shuffle_bytes_read"),
        m["Input Metrics"]["Records Read"].alias("input_records"),
    )
    return tasks.join(_stage_owner(events, group_property), "stage_id", "left")


def _stage_owner(events: DataFrame, group_property: str) -> DataFrame:
    """stage_id -> job_group of the first job that listed the stage."""
    jobs = (events.where(_event("SparkListenerJobStart"))
            .select(F.from_json("value", _JOB_START).alias("j"))
            .select(F.col("j")["Job ID"].alias("job_id"),
                    F.col("j")["Properties"][group_property].alias("job_group"),
                    F.explode(F.col("j")["Stage IDs"]).alias("stage_id")))
    return (jobs.groupBy("stage_id")
            .agg(F.min(F.struct("job_id", "job_group")).alias("o"))
            .select("stage_id", F.col("o.job_group").alias("job_group")))
