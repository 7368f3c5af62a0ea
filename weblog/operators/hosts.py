"""Host-name enrichment: a left join against a host directory, falling back to the IP.

Replaces per-row reverse-DNS calls with a join. The directory is not hinted
for broadcast: its size is not bounded by construction, so the choice is left
to AQE, which broadcasts it only when its measured size is under
``spark.sql.adaptive.autoBroadcastJoinThreshold`` and otherwise keeps a
shuffled join.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_hosts(df: DataFrame, directory: DataFrame, key: str = "client_ip",
                name: str = "hostname") -> DataFrame:
    """Add ``hostname``: the directory's name for the key, else the key itself.

    The directory is deduplicated first (one name per key, the smallest), so
    the join never multiplies rows.
    """
    d = directory.groupBy(key).agg(F.min(name).alias("_name"))
    return (df.join(d, key, "left")
            .withColumn(name, F.coalesce(F.col("_name"), F.col(key)))
            .drop("_name"))
