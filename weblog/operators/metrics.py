"""Benchmark measurement tables: union, idempotent upsert, payload flattening,
summaries, pivots, scale trends and stage-counter deltas.

A measurement table has one row per run: ``benchmark_id, scale_pct, query,
api, run`` plus metric columns (``elapsed_sec``, or stage counters). Summary
tables drop ``run`` and carry ``num_runs`` plus per-metric mean and std.
"""
from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from weblog.session import scratch_dir
from weblog.sources import snapshots

RUN_KEY = ["benchmark_id", "scale_pct", "query", "api", "run"]
SUMMARY_KEY = ["benchmark_id", "scale_pct", "query", "api"]

# The query families of a benchmark payload, in payload order.
QUERY_FAMILIES = (
    "error_pattern_analysis",
    "temporal_aggregation",
    "perhost_traffic_profiling",
    "perhost_traffic_profiling_naive",
    "sessionization",
)

# Stage counters and their unit scaling to seconds (times are ms and ns).
STAGE_COUNTERS = {
    "num_tasks": ("num_tasks", 1),
    "shuffle_read_bytes": ("shuffle_read_bytes", 1),
    "shuffle_write_bytes": ("shuffle_write_bytes", 1),
    "disk_bytes_spilled": ("disk_bytes_spilled", 1),
    "executor_deserialize_time_sec": ("executor_deserialize_time", 1000),
    "executor_cpu_time_sec": ("executor_cpu_time", 1_000_000_000),
}


def union_scales(frames: Mapping[int, DataFrame], scale_col: str = "scale_pct") -> DataFrame:
    """Union per-scale record sets, tagging each row with its scale.

    Columns are matched by name; a column missing from one set is null there.
    """
    if not frames:
        raise ValueError("no record sets to union")
    tagged = [df.withColumn(scale_col, F.lit(int(p))) for p, df in frames.items()]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def latest(records: DataFrame, key: Sequence[str] = RUN_KEY, version: str = "version") -> DataFrame:
    """One row per key: the row with the largest ``version`` (ties broken by the
    remaining columns, so the result is deterministic).

    A ``max(struct(version, row))`` aggregate: partial aggregation collapses
    duplicate keys before the shuffle, so a key repeated many times costs one
    row per map task, not one task holding the whole group.
    """
    key = list(key)
    rest = [c for c in records.columns if c not in key and c != version]
    best = F.max(F.struct(F.col(version), *[F.col(c) for c in rest])).alias("_best")
    return (records.groupBy(*key).agg(best)
            .select(*key, F.col(f"_best.{version}").alias(version),
                    *[F.col(f"_best.{c}").alias(c) for c in rest]))


def upsert(existing: DataFrame, incoming: DataFrame, key: Sequence[str] = RUN_KEY,
           version: str | None = None) -> DataFrame:
    """Merge ``incoming`` into ``existing``: one row per key, the last write wins.

    "Last" is the larger ``version`` when a version column is named; a null
    version is older than any other. Of equal versions (two nulls, too), and
    without a version column, ``incoming`` beats ``existing``. Only rows of one
    side with the same version are decided by their other columns, which must
    be orderable (no maps). Applying the same upsert twice changes nothing.
    """
    rank = "_upsert_rank"
    of = F.col(version) if version else F.lit(None).cast("string")
    left = existing.withColumn(rank, F.struct(of.alias("version"), F.lit(0).alias("side")))
    right = incoming.withColumn(rank, F.struct(of.alias("version"), F.lit(1).alias("side")))
    both = left.unionByName(right, allowMissingColumns=True)
    out = latest(both, key, rank)
    return out.select(*[c for c in both.columns if c != rank])


def merge_buckets(spark: SparkSession, root: str, table: str, incoming: DataFrame, key: Sequence[str] = RUN_KEY,
                  version: str | None = None, buckets: int = 64, base: snapshots.Snapshot | None = None) -> snapshots.Snapshot:
    """``upsert`` into a stored table that reads and rewrites only what an incoming key can touch.

    The table (a snapshot table, see ``weblog.sources.snapshots``) is kept in ``buckets`` parts by a hash
    of the key. Only the buckets that hold an incoming key are read, merged and written to new
    files; the new snapshot names them beside the old files of all other buckets. ``buckets`` is fixed by
    the first merge. The bucket column stays in the files' folder names only.
    """
    base = snapshots.snapshot(spark, root) if base is None else base
    notes = {**base.notes, f"{table}.buckets": buckets}
    if base.notes.get(f"{table}.buckets", buckets) != buckets:
        raise ValueError(f"{table} is kept in {base.notes[f'{table}.buckets']} buckets, not {buckets}")
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    staged = f"{scratch_dir(spark, 'merge')}/incoming"
    names = list(incoming.columns)
    if table in base.schemas:  # stored columns keep their order
        stored = [f["name"] for f in json.loads(base.schemas[table])["fields"]]
        names = stored + [c for c in names if c not in stored]
    incoming = latest(incoming, key, version) if version else incoming
    incoming = incoming.withColumn("_bucket", bucket)
    incoming.write.parquet(staged)
    incoming = spark.read.schema(incoming.schema).parquet(staged)
    touched = {f"_bucket={r._bucket}" for r in incoming.select("_bucket").distinct().collect()}  # at most ``buckets``
    merged = incoming
    if have := sorted(touched & base.tables.get(table, {}).keys()):
        merged = upsert(snapshots.read(spark, root, table, base, have).withColumn("_bucket", bucket), incoming, key, version)
    elif not version:
        merged = upsert(incoming.limit(0), incoming, key)
    return snapshots.commit(spark, root, {}, base, notes=notes, dealt={table: (merged.select(*names, "_bucket"), "_bucket")})


def payload_schema(run_fields: StructType, stats_fields: StructType,
                   queries: Sequence[str] = QUERY_FAMILIES) -> StructType:
    """Schema of a payload document: ``benchmark_id, scale_pct``, one array of
    run structs per query family, and ``summary: map<query, map<api, stats>>``."""
    from pyspark.sql.types import ArrayType, IntegerType, MapType, StringType, StructField
    fields = [StructField("benchmark_id", StringType()), StructField("scale_pct", IntegerType())]
    fields += [StructField(q, ArrayType(run_fields)) for q in queries]
    fields.append(StructField("summary", MapType(StringType(), MapType(StringType(), stats_fields))))
    return StructType(fields)


def flatten_runs(payloads: DataFrame, queries: Sequence[str] = QUERY_FAMILIES,
                 carry: Sequence[str] = ()) -> DataFrame:
    """Payload documents -> run records ``benchmark_id, scale_pct, query, <run fields>``
    (plus the top-level ``carry`` columns, e.g. ``generated_at_utc``).

    Families absent from the payload schema are skipped; a null array gives no rows.
    """
    present = [q for q in queries if q in payloads.columns]
    if not present:
        raise ValueError("payload has none of the query families")
    head = ["benchmark_id", "scale_pct", *carry]
    per_query = F.array(*[F.struct(F.lit(q).alias("query"), F.col(q).alias("runs"))
                          for q in present])
    return (payloads.select(*head, F.inline(per_query))
            .select(*head, "query", F.explode("runs").alias("r"))
            .select(*head, "query", "r.*"))


def flatten_summary(payloads: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Payload documents -> summary records ``benchmark_id, scale_pct, query, api, <stats>``."""
    head = ["benchmark_id", "scale_pct", *carry]
    return (payloads.select(*head, F.explode("summary").alias("query", "by_api"))
            .select(*head, "query", F.explode("by_api").alias("api", "stats"))
            .select(*head, "query", "api", "stats.*"))


def to_payloads(runs: DataFrame, summary: DataFrame, run_fields: Sequence[str],
                stats_fields: Sequence[str],
                queries: Sequence[str] = QUERY_FAMILIES, max_runs: int = 100_000) -> DataFrame:
    """Inverse of the flatteners: one payload document per (benchmark_id, scale_pct).

    A document holds the runs of one benchmark in one row. A benchmark with
    more than ``max_runs`` runs, and a run of a query outside ``queries``
    (which the document has no place for), is an error when the result is computed.
    Runs and summary records are shuffled once, together and as they are, and put into documents where they then lie.
    """
    of = F.struct("benchmark_id", "scale_pct").alias("_of")
    run = F.struct(*[F.col(c) for c in run_fields])
    entry = F.struct("api", F.struct(*[F.col(c) for c in stats_fields]).alias("stats"))
    rows = runs.select(of, "query", run.alias("_run")).unionByName(
        summary.select(of, "query", entry.alias("_entry")), allowMissingColumns=True)
    is_run = F.col("_run").isNotNull()
    # Counted by a window, before arrays are made: its exchange and order serve them, too, and a group's rows may spill there.
    n = F.count_if(is_run).over(Window.partitionBy("_of"))
    known = F.coalesce(F.col("query").isin(list(queries)), F.lit(False))
    fits = (F.when(is_run & ~known, F.raise_error(F.lit("a run's query has no place in the payload")).cast("boolean"))
            .when(F.col("_n") > max_runs, F.raise_error(F.lit("too many runs for one payload document")).cast("boolean"))
            .otherwise(F.lit(True)))
    # collect_list skips nulls, so each array keeps only its own query's runs.
    docs = rows.withColumn("_n", n).where(fits).groupBy("_of").agg(
        F.count_if(is_run).alias("_n"),
        *[F.collect_list(F.when(is_run & (F.col("query") == q), F.col("_run"))).alias(q) for q in queries],
        F.collect_list(F.when(~is_run, F.struct("query", "_entry"))).alias("_entries"))
    names = F.array_distinct(F.transform("_entries", lambda e: e["query"]))
    by_api = lambda q: F.map_from_entries(F.transform(
        F.filter("_entries", lambda e: e["query"].eqNullSafe(q)), lambda e: e["_entry"]))
    whole = F.map_from_entries(F.transform(names, lambda q: F.struct(q.alias("query"), by_api(q).alias("by_api"))))
    return docs.select("_of.*", *[F.when(F.col("_n") > 0, F.col(q)).alias(q) for q in queries],
                       F.when(F.size("_entries") > 0, whole).alias("summary"))


PART_FIELDS = ["part", "parts", "run_count"]


def to_payload_parts(runs: DataFrame, summary: DataFrame, run_fields: Sequence[str], stats_fields: Sequence[str],
                     queries: Sequence[str] = QUERY_FAMILIES, part_runs: int = 10_000) -> DataFrame:
    """Payload documents of bounded size: ``to_payloads`` for benchmarks of any number of runs.

    A (benchmark_id, scale_pct) has ``parts`` documents of about ``part_runs`` runs each, numbered by ``part``; ``run_count``
    says how many runs a part holds, and the summary is in part 0. Runs are dealt to parts by a hash, so no
    task holds a whole benchmark; equal runs are counted first and dealt in blocks. ``whole_parts`` checks on
    reading that nothing is lost. A run of a query outside ``queries`` is an error.
    """
    gk, block = ["benchmark_id", "scale_pct"], min(1000, part_runs)
    known = F.coalesce(F.col("query").isin(list(queries)), F.lit(False))
    fits = F.when(~known, F.raise_error(F.lit("a run's query has no place in the payload")).cast("boolean")).otherwise(F.lit(True))
    fields = list(dict.fromkeys(run_fields))
    same = runs.where(fits).groupBy(*gk, "query", *fields).agg(F.count(F.lit(1)).alias("_n"))
    at = F.struct(*gk)
    spine = (same.select(at.alias("_of"), "_n").unionByName(summary.select(at.alias("_of"), F.lit(0).cast("long").alias("_n")))
             .groupBy("_of").agg(F.greatest(F.lit(1).cast("long"), F.ceil(F.sum("_n") / F.lit(part_runs))).alias("parts")))
    blocks = same.select(at.alias("_of"), "query", F.struct(*fields).alias("_run"), "_n",
                         F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("div", F.col("_n") - 1, F.lit(block)))).alias("_b"))
    held = F.least(F.lit(block), F.col("_n") - F.col("_b") * block).cast("int")
    blocks = blocks.join(spine, "_of").select(
        "_of", "query", F.pmod(F.xxhash64("query", "_run", "_b"), F.col("parts")).alias("part"), held.alias("_held"),
        F.array_repeat("_run", held).alias("_runs"))
    docs = blocks.groupBy("_of", "part").agg(F.sum("_held").alias("run_count"), *[
        F.flatten(F.collect_list(F.when(F.col("query") == q, F.col("_runs")))).alias(q) for q in queries])
    by_api = summary.groupBy(at.alias("_of"), "query").agg(F.map_from_entries(F.collect_list(
        F.struct("api", F.struct(*[F.col(c) for c in stats_fields])))).alias("by_api"))
    summ = by_api.groupBy("_of").agg(F.map_from_entries(F.collect_list(F.struct("query", "by_api"))).alias("summary"))
    numbered = spine.select("_of", "parts", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    out = numbered.join(docs, ["_of", "part"], "left").join(summ.withColumn("part", F.lit(0).cast("long")), ["_of", "part"], "left")
    return out.select("_of.*", "part", "parts", F.coalesce("run_count", F.lit(0)).alias("run_count"), *queries, "summary")


def payload_part_schema(run_fields: StructType, stats_fields: StructType, queries: Sequence[str] = QUERY_FAMILIES) -> StructType:
    """Schema of a document of ``to_payload_parts``."""
    whole = payload_schema(run_fields, stats_fields, queries)
    return StructType([*whole.fields[:2], *[StructField(c, LongType()) for c in PART_FIELDS], *whole.fields[2:]])


def whole_parts(payloads: DataFrame, queries: Sequence[str] = QUERY_FAMILIES) -> DataFrame:
    """The documents of ``to_payload_parts``; reading them fails if a part is missing, comes twice or lacks runs.

    Only a benchmark all of whose parts are gone can't be noticed.
    """
    n = sum((F.greatest(F.size(F.coalesce(F.col(q), F.array())), F.lit(0)) for q in queries if q in payloads.columns),
            F.lit(0).cast("long"))
    seen = payloads.select(F.struct("benchmark_id", "scale_pct").alias("_of"), "part", "parts",
                           (n == F.col("run_count")).alias("_full"))
    state = seen.groupBy("_of").agg(F.count(F.lit(1)).alias("_docs"), F.count_distinct("part").alias("_parts"),
                                    F.min("parts").alias("_low"), F.max("parts").alias("_high"), F.min("_full").alias("_full"))
    good = ((F.col("_docs") == F.col("_parts")) & (F.col("_parts") == F.col("_low")) & (F.col("_low") == F.col("_high"))
            & F.col("_full"))
    what = F.concat(F.lit("payload parts are lost, repeated or cut: "), F.to_json("_of"))
    state = state.where(F.when(F.coalesce(good, F.lit(False)), F.lit(True)).otherwise(F.raise_error(what).cast("boolean")))
    given = payloads.withColumn("_of", F.struct("benchmark_id", "scale_pct"))
    return given.join(state.select("_of"), "_of").select(*payloads.columns)


def read_payloads(spark: SparkSession, root: str, file_name: str, schema: StructType,
                  multi_line: bool = True) -> DataFrame:
    """Every payload file named ``file_name`` under ``root`` (recursively).

    ``multi_line`` for pretty-printed one-document files (each file is read by
    one task); JSON-lines files can be split and should pass False. A damaged
    file fails the job that reads it: a payload that vanished would look like
    runs that never took place.
    """
    return (spark.read.schema(schema)
            .option("mode", "FAILFAST")
            .option("multiLine", multi_line)
            .option("recursiveFileLookup", True)
            .option("pathGlobFilter", file_name)
            .json(root))


def _norm_path(p: str) -> str:
    from urllib.parse import urlparse
    u = urlparse(p)
    return (u.path if u.scheme in ("", "file") else f"{u.scheme}://{u.netloc}{u.path}").rstrip("/")


def write_merged(merged: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a merged table to ``path``, refusing to overwrite one of its own inputs.

    The test walks the input file names, which the driver holds anyway to plan
    the scan: merged tables are small next to the logs they measure.
    """
    target = _norm_path(path)
    for f in merged.inputFiles():
        if _norm_path(f).startswith(target + "/"):
            raise ValueError(f"refusing to overwrite {path}: the merged table reads from it")
    merged.write.mode(mode).parquet(path)


def summarize(records: DataFrame, keys: Sequence[str], metrics: Sequence[str],
              sample: bool = False, naming: str = "prefix") -> DataFrame:
    """Per group: ``num_runs`` and mean + std of each metric.

    Population std by default (0 for a single run); ``sample=True`` gives the
    sample std (null for a single run). Column names are ``avg_<m>`` /
    ``std_<m>`` (``naming="prefix"``) or ``<m>_avg`` / ``<m>_std`` ("suffix").
    """
    std = F.stddev_samp if sample else F.stddev_pop

    def name(kind: str, m: str) -> str:
        return f"{kind}_{m}" if naming == "prefix" else f"{m}_{kind}"

    aggs: list[Column] = [F.count(F.lit(1)).alias("num_runs")]
    for m in metrics:
        aggs += [F.avg(m).alias(name("avg", m)), std(m).alias(name("std", m))]
    return records.groupBy(*keys).agg(*aggs)


def matrix(records: DataFrame, row: str, col: str, values: Sequence[str], metric: str) -> DataFrame:
    """Mean of ``metric`` as a ``row x col`` matrix with the columns in ``values`` order.

    Naming the pivot values avoids the extra job that discovers them and
    fixes the column order.
    """
    return records.groupBy(row).pivot(col, list(values)).agg(F.avg(metric))


def scale_trend(records: DataFrame, query: str, value: Column | str,
                scale: str = "scale_pct", api: str = "api") -> DataFrame:
    """For one query: mean and sample std of ``value`` per (scale, api)."""
    v = F.col(value) if isinstance(value, str) else value
    return (records.where(F.col("query") == query)
            .groupBy(scale, api)
            .agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std")))


def shuffle_total_mib(read: str = "shuffle_read_bytes", write: str = "shuffle_write_bytes") -> Column:
    """Shuffle read + write in MiB."""
    return (F.col(read) + F.col(write)) / F.lit(1024.0 * 1024.0)


def delta_totals(stages: DataFrame, snapshot: DataFrame, keys: Sequence[str] = (),
                 stage_id: str = "stage_id") -> DataFrame:
    """Totals of the stages that are not in ``snapshot`` (stages run since it).

    ``num_stages`` plus the sum of each stage counter, times scaled to seconds.
    The snapshot is matched with a left anti join on the stage id.
    """
    new = stages.join(snapshot.select(stage_id), stage_id, "left_anti")
    aggs = [F.count(F.lit(1)).alias("num_stages")]
    for out, (src, div) in STAGE_COUNTERS.items():
        s = F.sum(src)
        aggs.append((s / F.lit(float(div))).alias(out) if div != 1 else s.alias(out))
    return new.groupBy(*keys).agg(*aggs)
