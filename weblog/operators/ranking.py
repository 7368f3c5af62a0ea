"""Deterministic rankings and top-N reports.

Every ranking sorts on the metric, nulls last, then on the key(s), so ties
give the same rows on every run and on every engine. ``top_n`` plans as
``TakeOrderedAndProject``: each task keeps its own n best rows, only those
reach the final merge; nothing is collected to the driver.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rank_by(df: DataFrame, metric: str, keys: list[str] | str, descending: bool = True) -> DataFrame:
    keys = [keys] if isinstance(keys, str) else list(keys)
    m = F.col(metric)
    order = [m.desc_nulls_last() if descending else m.asc_nulls_last()]
    return df.orderBy(*order, *[F.col(k).asc() for k in keys])


def top_n(df: DataFrame, metric: str, keys: list[str] | str, n: int = 10,
          descending: bool = True) -> DataFrame:
    return rank_by(df, metric, keys, descending).limit(n)
