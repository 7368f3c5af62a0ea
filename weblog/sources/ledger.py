"""Incremental ingest: the table remembers which inputs it was made of.

A snapshot table (``weblog.sources.snapshots``) holds ``logs``, a part per batch, and ``inputs``, the ledger: path, length,
modification time and settings of every file a batch was parsed from. Rows and ledger are published together, so an input counts as
done exactly when its rows can be read.

A run lists the inputs, takes away those the ledger has with the same length, time and settings, and parses the rest
as one new batch. A file that has changed since, or was read with other settings, makes its whole batch stale: the batch is dropped in the
same commit and its files are parsed again. Inputs that are gone keep their rows (logs rotate away); a stale
batch with such a file can't be redone and is an error. What a broken run wrote belongs to no snapshot.
"""
from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblog.sources import snapshots

INPUTS = "path string, length long, modified timestamp, settings string, batch string"


def list_inputs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, length, modified of the files below a folder, or of a glob; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select("path", "length", F.col("modificationTime").alias("modified"))


def ledger(spark: SparkSession, root: str, base: snapshots.Snapshot | None = None) -> DataFrame:
    """The inputs the table was made of."""
    base = snapshots.snapshot(spark, root) if base is None else base
    return snapshots.read(spark, root, "inputs", base) if base.version else spark.createDataFrame([], INPUTS)


def ingest_new(spark: SparkSession, path: str | list[str], root: str, parse: Callable[[list[str]], DataFrame],
               settings: dict | None = None) -> dict:
    """Parse the inputs that the table at ``root`` doesn't have yet; ``parse`` makes rows of a list of files.

    Returns what was done: version, files, batches (redone). The list of files to parse comes to the driver, which
    hands it to the reader, as with any scan.
    """
    base = snapshots.snapshot(spark, root)
    own = json.dumps(settings or {}, sort_keys=True)
    now = list_inputs(spark, path).withColumn("settings", F.lit(own))
    known = ledger(spark, root, base)
    same = ["path", "length", "modified", "settings"]
    fresh = now.join(known.select(same), same, "left_anti")
    again = known.join(fresh.select("path"), "path", "left_semi").select("batch").distinct()
    stale = sorted(r.batch for r in again.collect())
    redo = known.where(F.col("batch").isin(stale)).select("path")
    lost = redo.join(now, "path", "left_anti").limit(3).collect()
    if lost:
        raise ValueError(f"a batch must be parsed again, but its inputs are gone: {[r.path for r in lost]}")
    todo = now.join(fresh.select("path").unionByName(redo).distinct(), "path", "left_semi")
    rows = todo.collect()
    if not rows:
        return {"version": base.version, "files": 0, "redone": []}
    batch = f"batch={base.version + 1:012d}"
    entries = spark.createDataFrame([(r.path, r.length, r.modified, own, batch) for r in rows], INPUTS)
    changes = {"logs": {batch: parse(sorted(r.path for r in rows)), **dict.fromkeys(stale)},
               "inputs": {batch: entries.coalesce(1), **dict.fromkeys(stale)}}
    done = snapshots.commit(spark, root, changes, base)
    return {"version": done.version, "files": len(rows), "redone": stale}
