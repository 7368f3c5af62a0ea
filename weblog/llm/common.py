"""Helpers shared by the training-data operators."""
from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblog.session import scratch_dir

#: White space between words, as the contracts fix it: U+0020 and U+0009-U+000D.
WHITE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Select ``new=old`` columns by exact name.

    Extra columns are left out, whatever they are called: also one that differs
    from a wanted name only in case, or repeats it (then the first counts).
    """
    at = {}
    for i, name in enumerate(df.columns):
        at.setdefault(name, i)
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{at[old]}").alias(new) for new, old in wanted.items()])


def _plain_scan(df: DataFrame) -> bool:
    """Whether every row is one stored row of one table on files: nothing but columns and filters above a single scan."""
    try:
        node = df._jdf.queryExecution().analyzed()
    except Exception:  # noqa: BLE001  a session without a JVM of its own
        return False
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    return node.nodeName() in ("LogicalRelation", "Relation")


def placed(df: DataFrame) -> DataFrame:
    """The columns of ``df`` by position as c0, c1, ..., and the file and row that are its rows' own place.

    A plain scan of files has such places; any other frame (joined, exploded, made in memory) is written first.
    """
    plain = [f"c{i}" for i in range(len(df.columns))]
    place = ["_metadata.file_path", "_metadata.row_index"]
    if _plain_scan(df):
        try:
            return df.select("*", *place).toDF(*plain, "file", "row")
        except AnalysisException:  # files of a format that doesn't number its rows
            pass
    return written(df.toDF(*plain), "placed-rows").select("*", *place).toDF(*plain, "file", "row")


def portions(texts: list, limit: int):
    """Slices (start, end) of a list of texts that hold about ``limit`` characters at most, or one text."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > limit:
            yield start, i
            start, size = i, 0
        size += len(t or "")
    if start < len(texts):
        yield start, len(texts)


#: What operators keep in a worker between tasks: name -> function that lets it go.
KEPT: dict[str, Callable[[], None]] = {}


def make_room(keep: str = "") -> None:
    """Let go of what other operators keep in this worker; a worker serves one stage after another."""
    for name, let_go in KEPT.items():
        if name != keep:
            let_go()
    release()


def release() -> None:
    """Give memory that this worker has freed back to the system: Arrow's pool and, where there is one, the C allocator's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back.

    This cuts the lineage: later stages, and retries after a lost executor, start
    from the table.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark, name)}/table"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
