"""Raw access-log text sources."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8",
               repartition: int | None = None) -> DataFrame:
    """Read log lines into ``DataFrame[value: string]``.

    Gzip files are read whole by one task each (the codec is not splittable);
    pass ``repartition`` to spread the lines over ``n`` partitions right after
    the read, before any parsing work.
    """
    df = spark.read.option("encoding", encoding).text(path)
    if repartition:
        df = df.repartition(repartition)
    return df


def sample_lines(lines: DataFrame, percent: float, seed: int | None = None) -> DataFrame:
    """Bernoulli sample of about ``percent`` % of the lines (no-op at >= 100).

    Sampling is per row and per partition, so its size is approximate, and
    another layout of the same lines gives another sample.
    """
    if percent < 0:
        raise ValueError("percent must not be negative")
    if percent >= 100:
        return lines
    return lines.sample(withReplacement=False, fraction=percent / 100.0, seed=seed)


def sample_lines_by_content(lines: DataFrame, percent: float, seed: int = 42, value: str = "value") -> DataFrame:
    """A sample of about ``percent`` % that depends on the lines alone.

    A line is kept when the first 32 bits of the MD5 of seed and line fall below the share, so any
    layout, engine or rerun keeps the same lines; equal lines go together.
    """
    if percent < 0:
        raise ValueError("percent must not be negative")
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(value)))
    return lines.where(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") < int(percent / 100.0 * 2**32))
