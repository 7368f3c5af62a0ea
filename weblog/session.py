"""SparkSession builder: UTC session zone, AQE with skew handling, ANSI left on."""
from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.ui.enabled": "false",
}


# Large-cluster profile (hundreds of TB of logs). Shuffles start wide and AQE
# coalesces them to ~256 MB partitions, so the width adapts to the data actually
# shuffled (after partial aggregation that is far less than the input). Scan
# splits of 256 MB keep the task count of a 100 TB scan near 400k. A partition is
# treated as skewed at 5x the median and 512 MB, and then split by AQE. Joins
# broadcast a side only when its measured size is under 64 MB.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "8192",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "8192",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
}


def build(
    app_name: str = "weblog",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    conf: dict[str, str] | None = None,
    profile: str = "default",
) -> SparkSession:
    """Return a session configured for log analytics.

    ``master`` is left to ``spark-submit`` when None. ``profile="cluster"`` adds
    ``CLUSTER_CONF``. ANSI mode is not touched (it is on by default in Spark 4);
    every raw-string conversion in this package uses ``try_*`` functions so
    malformed input yields nulls, not errors.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    settings = dict(DEFAULT_CONF)
    if profile == "cluster":
        settings.update(CLUSTER_CONF)
    elif profile != "default":
        raise ValueError(f"unknown profile {profile!r}")
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ensure_utc(spark: SparkSession) -> None:
    """Pin the session zone to UTC: hours and dates in this package are UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def _context(spark: SparkSession):
    """The SparkContext, or None on a session without one (Spark Connect)."""
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001
        return None


def default_parallelism(spark: SparkSession) -> int:
    sc = _context(spark)
    if sc is not None:
        return sc.defaultParallelism
    return int(spark.conf.get("spark.sql.shuffle.partitions", "8"))


def _is_local(spark: SparkSession) -> bool:
    """One JVM on one machine (``local-cluster`` has executors of its own)."""
    master = spark.conf.get("spark.master", "")
    return master == "local" or master.startswith("local[")


def scratch_dir(spark: SparkSession, name: str = "weblog") -> str:
    """A fresh directory path under the cluster's shared ``spark.checkpoint.dir``.

    The shared folder is read from the session. Where it is unset, a local run
    (tests) gets a temporary folder, registered as the checkpoint folder and
    removed at the end of the process; any other master is refused, since
    executors would not see each other's files there. ``clean_scratch`` removes
    what this session got.
    """
    sc = _context(spark)
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and sc is not None:
        base = sc.getCheckpointDir()
    if not base:
        if not _is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="weblog-ckpt-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        if sc is not None:
            sc.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    if "://" not in path or path.startswith("file:"):
        os.makedirs(path.replace("file:", "", 1), exist_ok=True)
    return path


_SCRATCH: list[str] = []


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as it wants it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def clean_scratch(spark: SparkSession) -> None:
    """Delete the folders that ``scratch_dir`` has given out; call it when no result needs them."""
    while _SCRATCH:
        fs, at = file_system(spark, _SCRATCH.pop())
        fs.delete(at, True)


def shuffle_width(input_bytes: int, partition_bytes: int = 256 << 20, least: int = 200) -> int:
    """Shuffle partitions for an input: no partition over ``partition_bytes`` even if nothing is reduced.

    AQE merges small partitions but does not split an aggregate's, so the width starts from the data.
    """
    return max(least, -(-int(input_bytes) // partition_bytes))


def input_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files below a path (or a glob of paths)."""
    fs, at = file_system(spark, path)
    return sum(fs.getContentSummary(s.getPath()).getLength() for s in (fs.globStatus(at) or []))
