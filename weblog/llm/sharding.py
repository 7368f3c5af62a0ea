"""Sharding by a two-pass external shuffle.

Pass one scatters the records over memory-sized buckets by a seeded hash of their identifier and place in the table, so copies of a
text or of an identifier spread like any others. Spark's shuffle files hold the buckets on disk. Pass two takes one bucket after the other
into a task, brings it into a fixed order and Fisher-Yates shuffles it (numpy's ``permutation``, seeded by
the bucket). The buckets in their order are a random permutation of all records; the shards are its even stretches, so
their row counts differ by one at most (law ``rows``).

Where a bucket begins in the permutation follows from the rows per bucket, which are counted without reading a text and summed
over ranges of buckets first. Each bucket gets its start as a marker row that sorts first in it, so texts cross the network
once, and neither starts nor counts are broadcast. ``write_shards`` writes the shards: the tasks hold neighbouring buckets, so a
shard's files in name order, each in row order, are its slots in order.

Memory: a task holds one bucket (``BUCKET_BYTES`` of text on average, and at least one record). Reruns on the same files agree; a lost executor's tasks give the same rows again,
since hash and order depend on the stored rows only (frames that aren't plain scans of files are written first).

Defined cases: a null text has size 1 and checksum 0; a null or repeated doc_id and repeated rows are records of their
own; extra columns are carried by position, whatever their names; fewer records than shards leave the last ones
empty or not evenly numbered, one record at most in each; no records give no rows.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weblog.llm.common import placed, table, written

SHARDS, SEED, BUCKET_BYTES = 8, 13, 16 << 20
#: Buckets whose counts are summed together before the prefix sums.
RANGE = 1024


def size(text: Column) -> Column:
    """UTF-8 bytes of the text plus 1; null: 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(1).cast("long")


def starts(counts: DataFrame) -> DataFrame:
    """bucket, start: how many rows lie in the buckets before. ``counts``: bucket, n."""
    counts = counts.withColumn("range", F.call_function("div", F.col("bucket"), F.lit(RANGE)))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.groupBy("range").agg(F.sum("n").alias("n")).select(
        "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("range").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(ranges, "range").select(
        "bucket", (F.col("base") + F.col("inside")).alias("start"))


def shuffled_buckets(names: list[str], schema: T.StructType, seed: int):
    """Fisher-Yates over each bucket of a partition sorted by bucket, marker rows first; adds each row's position."""
    carried = len(names)

    def emit(bucket: int, start: int, held: list):
        rows = pa.Table.from_batches(held)
        order = np.random.Generator(np.random.Philox(key=[seed, bucket])).permutation(len(rows))
        rows = rows.take(pa.array(order)).append_column("position_", pa.array(start + np.arange(len(rows))))
        for batch in rows.combine_chunks().to_batches(max_chunksize=2000):
            yield pa.RecordBatch.from_arrays(batch.columns, schema.names)

    def run(batches):
        bucket, start, held = None, 0, []
        for batch in batches:
            of = batch.column(carried).to_numpy()
            mark = batch.column(carried + 1).to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            for a, b in zip(edge, np.append(edge[1:], len(of))):
                if of[a] != bucket:
                    if held:
                        yield from emit(bucket, start, held)
                    bucket, held = int(of[a]), []
                if mark[a] >= 0:
                    start, a = int(mark[a]), a + 1
                if a < b:
                    held.append(pa.RecordBatch.from_arrays(batch.slice(a, b - a).columns[:carried], names))
        if held:
            yield from emit(bucket, start, held)

    return run


def sharded(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows and columns of ``docs`` with ``shard`` and ``slot`` (from 0 in each shard) behind them."""
    spark = docs.sparkSession
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = placed(docs)
    text, doc_id = (F.col(names[docs.columns.index(c)]) for c in ("text", "doc_id"))
    found = rows.agg(F.sum(size(text)).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    buckets, total = max(1, -(-(found.bytes or 0) // bucket_bytes)), found.rows
    mixed = F.xxhash64(F.lit(seed), doc_id, F.element_at(F.split("file", "/"), -1), "row")
    rows = rows.withColumn("order_", mixed).withColumn("bucket_", F.pmod(F.xxhash64(F.lit(seed + 1), "order_"), F.lit(buckets)))
    marks = starts(rows.groupBy(F.col("bucket_").alias("bucket")).agg(F.count(F.lit(1)).alias("n")))
    rows = rows.select(*names, "bucket_", F.lit(-1).cast("long").alias("start_"), "order_", "file", "row")
    marks = marks.select(F.col("bucket").alias("bucket_"), F.col("start").alias("start_"))

    parts = int(min(buckets, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = rows.unionByName(marks, allowMissingColumns=True).repartitionById(
        parts, F.call_function("div", F.col("bucket_") * F.lit(parts), F.lit(buckets)).cast("int"))
    dealt = dealt.sortWithinPartitions("bucket_", F.desc("start_"), "order_", "row", "file").drop("order_", "file", "row")
    plain = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, docs.schema.fields)])
    schema = T.StructType([*plain.fields, T.StructField("position_", T.LongType())])
    done = dealt.mapInArrow(shuffled_buckets(names, schema, seed), schema)
    position, n, s = F.col("position_"), F.lit(max(total, 1)), F.lit(shards)
    shard = F.call_function("div", (position + 1) * s - 1, n)
    done = done.withColumn("shard_", shard.cast("int")).withColumn(
        "slot_", position - F.call_function("div", F.col("shard_") * n, s))
    return done.drop("position_").toDF(*docs.columns, "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Write ``docs`` as Parquet below ``path``, a folder ``shard=N`` for each shard."""
    sharded(docs, shards, seed, bucket_bytes).write.partitionBy("shard").parquet(path)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = written(sharded(table(spark, sf_dir, "documents")), "shards")
    return made.select("doc_id", size(F.col("text")).alias("size"),
                       F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
                       F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
