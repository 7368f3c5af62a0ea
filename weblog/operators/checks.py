"""Result equality checks that run as Spark jobs (no collect of the frames)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def _normalised(df: DataFrame, columns: list[str], digits: int) -> DataFrame:
    out: list[Column] = []
    for c in columns:
        t = df.schema[c].dataType
        col = F.col(c)
        out.append((F.round(col, digits) if isinstance(t, (DoubleType, FloatType)) else col).alias(c))
    return df.select(*out)


def diff_rows(left: DataFrame, right: DataFrame, digits: int = 6) -> DataFrame:
    """Rows in one frame and not in the other, as multisets, with a ``side`` column.

    Columns are matched by name (order ignored); doubles are compared after
    rounding to ``digits`` decimals (a relative tolerance cannot be expressed
    as a set difference; rounding is its usual substitute).
    """
    if sorted(left.columns) != sorted(right.columns):
        raise ValueError(f"column sets differ: {sorted(left.columns)} vs {sorted(right.columns)}")
    cols = sorted(left.columns)
    a, b = _normalised(left, cols, digits), _normalised(right, cols, digits)
    # Each side is read once: +1 and -1 per row, and what doesn't cancel differs.
    both = a.withColumn("_sign", F.lit(1)).unionByName(b.withColumn("_sign", F.lit(-1)))
    left_over = both.groupBy(*cols).agg(F.sum("_sign").alias("_more")).where("_more <> 0")
    return (left_over.withColumn("side", F.when(F.col("_more") > 0, "left").otherwise("right"))
            .withColumn("_each", F.explode(F.sequence(F.lit(1), F.abs("_more").cast("int"))))
            .drop("_more", "_each"))


def same_rows(left: DataFrame, right: DataFrame, label: str = "", digits: int = 6) -> DataFrame:
    """One row ``(label, equal)``: true when both frames hold the same rows."""
    d = diff_rows(left, right, digits)
    return d.agg((F.count(F.lit(1)) == 0).alias("equal")).select(
        F.lit(label).alias("family"), "equal")
