"""Canonical access-log schema and the step that enforces it."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DateType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

# Column names, types and nullability of the output table.
ACCESS_LOG_SCHEMA = StructType(
    [
        StructField("client_ip", StringType(), False),
        StructField("log_ts", TimestampType(), False),
        StructField("http_method", StringType(), False),
        StructField("request_path", StringType(), False),
        StructField("http_version", StringType(), True),
        StructField("status_code", IntegerType(), False),
        StructField("response_bytes", LongType(), True),
        StructField("log_date", DateType(), False),
    ]
)

ACCESS_LOG_COLUMNS = [f.name for f in ACCESS_LOG_SCHEMA.fields]


def conform(df: DataFrame, schema: StructType = ACCESS_LOG_SCHEMA) -> DataFrame:
    """Select the schema's columns in order, cast to its types; fail on a missing column."""
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns for schema: {missing}")
    return df.select(
        *[
            (F.col(f.name) if df.schema[f.name].dataType == f.dataType
             else F.col(f.name).cast(f.dataType)).alias(f.name)
            for f in schema.fields
        ]
    )
