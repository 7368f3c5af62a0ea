"""Parsed-line table -> canonical access-log table."""
from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, IntegerType, LongType, StringType

from weblog.functions.logline import ALLOWED_METHODS
from weblog.schema import ACCESS_LOG_SCHEMA


# Where a canonical column's raw form stands in a parsed line, if under another name.
RAW = {"status_code": "status_str", "response_bytes": "bytes_str"}
# Columns written in capitals, and the raw value that stands for "nothing was sent".
CAPITALS, NOTHING = ("http_method",), "-"
STATUS = (100, 600)


def _typed(name: str, kind: DataType) -> Column:
    """A canonical column from its raw form: trimmed text (blank is null), or a number or null."""
    raw = F.col(RAW.get(name, name))
    if isinstance(kind, DateType):
        return F.to_date(F.col("log_ts"))
    if isinstance(kind, StringType):
        text = F.upper(F.trim(raw)) if name in CAPITALS else F.trim(raw)
        return F.nullif(text, F.lit(""))
    if isinstance(kind, (IntegerType, LongType)):
        return F.nullif(raw, F.lit(NOTHING)).try_cast(kind)
    return raw


def normalise() -> list[Column]:
    """Projection to the canonical columns, in schema order."""
    return [_typed(f.name, f.dataType).alias(f.name) for f in ACCESS_LOG_SCHEMA]


def keep_mask(strict_http_method: bool = False) -> Column:
    """Boolean column: would ``clean_logs`` keep this parsed line?

    A matched line whose required columns (those the schema doesn't allow to
    be null) all have a value, with a status in range; with
    ``strict_http_method`` the method must be one of the allowed verbs.
    """
    column = {f.name: _typed(f.name, f.dataType) for f in ACCESS_LOG_SCHEMA}
    tests = [F.col("line_matched")]
    tests += [column[f.name].isNotNull() for f in ACCESS_LOG_SCHEMA if not f.nullable]
    tests.append(column["status_code"].between(STATUS[0], STATUS[1] - 1))
    if strict_http_method:
        tests.append(column["http_method"].isin(list(ALLOWED_METHODS)))
    return F.coalesce(reduce(and_, tests), F.lit(False))


def clean_logs(parsed: DataFrame, strict_http_method: bool = False) -> DataFrame:
    """Drop invalid lines and project to the canonical schema (``ACCESS_LOG_SCHEMA``)."""
    return parsed.where(keep_mask(strict_http_method)).select(*normalise())
