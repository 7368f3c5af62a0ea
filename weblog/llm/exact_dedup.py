"""Exact dedup: keyed streaming state of digests, full bytes checked on hits.

Texts are equal when they agree after every character of ``[\\x20\\x09-\\x0D]`` is
deleted. A structured-streaming aggregation keyed by the digest keeps, without
expiry, one state row per distinct text in RocksDB: the digest, the best document so far
(most code points, then smallest doc_id) with the file and row where its text lies, and the
number of copies. State and progress live in the query's checkpoint, so a lost
executor or a restarted driver resumes; given the same ``state_dir`` again, a
later run adds only the new records to the state.

Equal digests are only hits. The texts of all hits are then grouped by their full
bytes; a digest that covers several texts is split into as many groups. Everything
here is DataFrame code, and copies collapse map-side, so a group holding a third of
all rows does not reach one task.

Defined cases: a null text counts as empty, and empty texts are copies of each other; a
null doc_id loses to any other id; among repeated rows the one that lies first
(by file, then row) stays; extra columns are carried by position; an empty table gives an empty result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weblog.llm.common import WHITE, placed, table, written
from weblog.session import scratch_dir

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: State on disk; many small stores must not each reserve megabytes for their manifests.
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": PROVIDER,
            "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
            # All stores of an executor share one bound, and are closed once they have committed.
            "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
            "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
            "spark.sql.streaming.stateStore.unloadOnCommit": "true"}


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def sha256(norm: Column) -> Column:
    return F.sha2(norm, 256)


def located(docs: DataFrame) -> DataFrame:
    """doc_id, text, file and row of ``docs``, and all its columns by position as c0, c1, ..."""
    at = {name: f"c{docs.columns.index(name)}" for name in ("doc_id", "text")}
    return placed(docs).select(
        "*", F.col(at["doc_id"]).cast("long").alias("doc_id"), F.col(at["text"]).alias("text"))


def records(rows: DataFrame, digest=sha256) -> DataFrame:
    """One slim row per located document: digest, identifier, length and locator."""
    return rows.select(digest(normalised(F.col("text"))).alias("digest"), "doc_id",
                       F.coalesce(F.length("text"), F.lit(0)).alias("n_code_points"), "file", "row")


def _best() -> Column:
    """The document that stays, as the least struct."""
    return F.min(F.struct((-F.col("n_code_points")).alias("order"), F.col("doc_id").isNull().alias("no_id"),
                          "doc_id", "file", "row"))


def stream_state(slim: DataFrame, path: str, state_dir: str, files_per_batch: int = 1000) -> DataFrame:
    """Run the stateful aggregation over the records at ``path`` until all are read.

    Returns the latest state row of every digest. ``state_dir`` holds the state
    and what each micro-batch changed; a second call with the same folder goes on
    where the first ended.
    """
    spark = slim.sparkSession
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(slim.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
        state = stream.groupBy("digest").agg(_best().alias("best"), F.count(F.lit(1)).alias("group_size"))

        def keep(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{state_dir}/changed/batch={batch_id}")

        (state.writeStream.outputMode("update").foreachBatch(keep)
         .option("checkpointLocation", f"{state_dir}/checkpoint")
         .trigger(availableNow=True).start().awaitTermination())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if slim.isEmpty():
        return slim.groupBy("digest").agg(_best().alias("best"), F.count(F.lit(1)).alias("group_size"))
    schema = slim.groupBy("digest").agg(_best().alias("best"), F.count(F.lit(1)).alias("group_size")).schema
    changed = spark.read.schema(schema.add("batch", "long")).parquet(f"{state_dir}/changed")
    last = changed.groupBy("digest").agg(F.max(F.struct("batch", "best", "group_size")).alias("last"))
    return last.select("digest", "last.best", "last.group_size")


def dedup(docs: DataFrame, digest=sha256) -> DataFrame:
    """One row per document: doc_id, file, row, keep_id, group_size, kept, text_sha256.

    ``digest`` is the function of the normalised text that keys the state.
    """
    return _dedup(located(docs), digest)


def _dedup(rows: DataFrame, digest=sha256) -> DataFrame:
    spark = rows.sparkSession
    path = f"{scratch_dir(spark, 'dedup-records')}/table"
    made = records(rows, digest)
    made.write.parquet(path)
    slim = spark.read.schema(made.schema).parquet(path)
    groups = written(stream_state(slim, path, scratch_dir(spark, "dedup-state")), "dedup-groups")

    hits = groups.where("group_size > 1").select("digest")
    full = rows.select(normalised(F.col("text")).alias("norm"), "doc_id",
                       F.coalesce(F.length("text"), F.lit(0)).alias("n_code_points"), "file", "row")
    full = full.withColumn("digest", digest(F.col("norm")))
    checked = full.join(hits, "digest", "left_semi")
    texts = checked.groupBy("digest", "norm").agg(_best().alias("best"), F.count(F.lit(1)).alias("group_size"))
    # A digest of one text stays as it is; only the bytes of several are carried on.
    per_digest = texts.groupBy("digest").agg(F.count(F.lit(1)).alias("n_texts"))
    collided = written(per_digest.where("n_texts > 1").select("digest"), "dedup-collided")

    def out(rows: DataFrame, sha: Column) -> DataFrame:
        best = F.col("best")
        return rows.select("doc_id", "file", "row", best["doc_id"].alias("keep_id"), "group_size",
                           ((best["file"] == F.col("file")) & (best["row"] == F.col("row"))).alias("kept"),
                           sha.alias("text_sha256"))

    if digest is sha256 and collided.isEmpty():
        return out(slim.join(groups, "digest"), F.col("digest"))
    own = full.join(collided, "digest", "left_semi").join(texts, ["digest", "norm"])
    rest = full.join(collided, "digest", "left_anti").join(groups, "digest")
    return out(own, sha256(F.col("norm"))).unionByName(out(rest, sha256(F.col("norm"))))


def unique(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    rows = located(docs)
    kept = _dedup(rows).where("kept").select("file", "row")
    plain = [f"c{i}" for i in range(len(docs.columns))]
    return rows.join(kept, ["file", "row"], "left_semi").select(*plain).toDF(*docs.columns)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = r"""
WITH n AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
r AS (
  SELECT *, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id
  FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
"""
