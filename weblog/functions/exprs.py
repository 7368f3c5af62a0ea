"""Small column builders: error predicate, guarded ratios, epoch seconds."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_error(status: str | Column = "status_code") -> Column:
    """HTTP error: ``400 <= status < 600`` (client and server errors).

    A bare-column range predicate, so it is pushed into the Parquet scan.
    """
    s = col_of(status)
    return (s >= 400) & (s < 600)


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` as double, null when ``den`` is 0 (ANSI-safe division)."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def percent(num: Column, den: Column) -> Column:
    """``num / den * 100`` as double, null when ``den`` is 0."""
    return ratio(num, den) * F.lit(100.0)


def epoch_seconds(ts: str | Column = "log_ts") -> Column:
    """Whole epoch seconds of a timestamp (the log's resolution is 1 s)."""
    return F.unix_timestamp(col_of(ts))
