"""Incremental ingest: new raw log files -> the cleaned Parquet table.

The same parse and clean operators run on a streaming text source; the
Parquet sink and the checkpoint give exactly-once output per file, so a
rerun after a failure (or a lost executor) neither loses nor duplicates
lines. ``available_now`` processes everything present and stops, which
makes the stream a restartable batch job over a growing log directory.
"""
from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from weblog.operators.clean import clean_logs
from weblog.operators.parse import parse_lines


def start_ingest(spark: SparkSession, source_dir: str, output_path: str,
                 checkpoint_path: str | None = None, strict_http_method: bool = False,
                 by_date: bool = False, max_files_per_trigger: int | None = None,
                 available_now: bool = True) -> StreamingQuery:
    """Start the stream; the caller waits on or stops the returned query.

    ``checkpoint_path`` defaults to a hidden folder inside the output, so a
    second start over the same output always resumes the first: table and
    progress belong together.
    """
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    cleaned = clean_logs(parse_lines(reader.load(source_dir)),
                         strict_http_method=strict_http_method)
    writer = (cleaned.writeStream.format("parquet")
              .option("path", output_path)
              .option("checkpointLocation", checkpoint_path or f"{output_path.rstrip('/')}/_ingest_checkpoint")
              .outputMode("append"))
    if by_date:
        writer = writer.partitionBy("log_date")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
