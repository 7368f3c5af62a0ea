"""Parquet source and sink of the canonical access-log table."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblog.schema import conform
from weblog.session import file_system


def read_logs(spark: SparkSession, path: str, columns: list[str] | None = None,
              epoch_seconds: bool = False,
              date_from: str | dt.date | None = None,
              date_to: str | dt.date | None = None) -> DataFrame:
    """Read the access-log Parquet table.

    ``columns`` prunes the scan. ``epoch_seconds`` replaces ``log_ts`` by its
    whole epoch seconds (bigint). ``date_from`` / ``date_to`` (inclusive) filter
    on ``log_date``; on a date-partitioned table that is partition pruning.
    """
    df = spark.read.parquet(path)
    if date_from is not None:
        df = df.where(F.col("log_date") >= F.lit(date_from).cast("date"))
    if date_to is not None:
        df = df.where(F.col("log_date") <= F.lit(date_to).cast("date"))
    if columns:
        df = df.select(*columns)
    if epoch_seconds and "log_ts" in df.columns:
        df = df.withColumn("log_ts", F.unix_timestamp("log_ts"))
    return df


def register_logs(spark: SparkSession, path: str, view: str) -> DataFrame:
    """Read the table and expose it as temp view ``view``; returns the DataFrame."""
    df = read_logs(spark, path)
    df.createOrReplaceTempView(view)
    return df


def write_logs(df: DataFrame, path: str, partitions: int | None = None,
               by_date: bool = False, mode: str = "overwrite",
               compression: str = "snappy", rebalance: bool = False) -> None:
    """Write the access-log table as Parquet.

    The frame is conformed to ``ACCESS_LOG_SCHEMA``: a missing column is an
    error, columns outside the schema are left out.

    ``partitions`` round-robins the rows into ``n`` write tasks (a full
    shuffle; use it to fix the file count). ``by_date`` lays the table out as
    ``log_date=YYYY-MM-DD`` directories. By default the scan tasks write their
    dates directly, with no shuffle: logs are appended in time order, so a
    split holds one or two dates and yields one or two split-sized files.
    For unordered input pass ``rebalance=True``: rows are then rebalanced on
    ``log_date`` by AQE, which splits a hot date over several tasks instead of
    sending it to one. ``mode="ignore"`` makes the write idempotent: a table that
    was written whole is left alone, what a broken write left is replaced.
    ``"overwrite"`` forces it.
    """
    out = conform(df)
    if mode == "ignore":
        if committed(df.sparkSession, path):
            return
        mode = "overwrite"
    if partitions:
        out = out.repartition(partitions)
    elif by_date and rebalance:
        out = out.hint("rebalance", "log_date")
    w = out.write.mode(mode).option("compression", compression)
    if by_date:
        w = w.partitionBy("log_date")
    w.parquet(path)


def committed(spark: SparkSession, path: str) -> bool:
    """True if a write to ``path`` has ended: its success marker is there."""
    fs, at = file_system(spark, f"{path.rstrip('/')}/_SUCCESS")
    return fs.exists(at)


def verify_written(spark: SparkSession, path: str) -> int:
    """Read the table back and return its row count; raise if it is empty."""
    n = spark.read.parquet(path).count()
    if n == 0:
        raise RuntimeError(f"read-back row count is 0: {path}")
    return n
