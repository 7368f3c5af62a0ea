"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sizes are word counts. Sources in code-point order (null last) weigh 5, 2, 1, 5, ...
and share all words; a target stops at ``MOST`` times its source's size and the excess is
reshared by weight until none is above. Sorted by size over weight, the capped
sources come first, so the shares follow from running sums.

A seeded hash of the document puts it into one of its source's ``blocks``. A pass over the
source draws its blocks in an order of its own, a keyed permutation of the block numbers.
A source whose target is r times its size gives floor(r) whole passes, then blocks of one more
pass while they fit, then documents of the next block, by a second hash, while
that brings the taken words closer to the target.

The blocks drawn are the source's quota. A tree over the output shards splits all quotas:
at each node the draws of its left half are taken from the node's draws without
replacement, by one multivariate-hypergeometric draw over the sources, with a
generator keyed by the node's place. So each shard gets a stretch of every source's
sequence of draws, disjoint from the other shards'. In a shard, the order is by a seeded hash.

What a document needs to know is its source's row of the plan: passes, the
place where the last pass stops, and where each shard's stretch ends. Plan and tree work
on one row per source, in one task: the number of sources belongs to the mixture and does not
grow with the corpus. Block sums are pre-aggregated map-side, so a hot source does not
gather; only the documents of a source's one last block are sorted together.

Defined cases: a null text has size 0; documents of size 0 go along with their
block and take nothing; a source without words has target 0 and gives nothing; rows that
agree in doc_id and text fare alike; an empty table gives an empty mix; reruns agree.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weblog.llm.common import pick, table, written

#: The weights that repeat over the ordered sources, and the most passes (fixed values).
WEIGHTS, MOST = (5, 2, 1), 3
#: Blocks of each source (a power of two), output shards, and the seed of all draws.
BLOCKS, SHARDS, SEED = 1024, 64, 17


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target of the rows source, source_size."""
    name = [F.col("source").isNull(), F.col("source")]
    turn = ((F.row_number().over(Window.orderBy(*name)) - 1) % len(WEIGHTS) + 1).cast("int")
    w = sizes.withColumns({"weight": F.element_at(F.array(*[F.lit(float(x)) for x in WEIGHTS]), turn),
                           "cap": (F.col("source_size") * MOST).cast("double")})
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), *name)
    w = w.withColumns({
        "left": F.sum("source_size").over(Window.partitionBy()) - F.coalesce(
            F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "weights": F.sum("weight").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        "at": F.row_number().over(by_cap)})
    # Words per weight if this source and all after it share what is left.
    w = w.withColumn("level", F.col("left") / F.col("weights"))
    w = w.withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    level = F.min(F.when(~F.col("capped"), F.struct("at", "level"))).over(Window.partitionBy())["level"]
    return w.withColumn("common", level).select(
        "source", "source_size",
        F.when(F.col("capped"), F.col("cap")).otherwise(F.col("common") * F.col("weight")).alias("target"))


def split_quotas(draws: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Draws of each source (rows) in each shard (columns), from the draws of each source."""
    out = np.zeros((len(draws), shards), dtype=np.int64)
    todo = [(0, shards, np.asarray(draws, dtype=np.int64))]
    while todo:
        first, n, have = todo.pop()
        if n == 1:
            out[:, first] = have
            continue
        half = n // 2
        rng = np.random.Generator(np.random.Philox(key=[seed, first * (shards + 1) + n]))
        take = int(have.sum()) * half // n
        left = rng.multivariate_hypergeometric(have, take, method="marginals") if take else np.zeros_like(have)
        todo += [(first, half, left), (first + half, n - half, have - left)]
    return out


def _parts(blocks: int, seed: int) -> dict[str, Column]:
    """Inner columns of a document: source, size, block, and its place in a block."""
    return {"source_": F.col("source"), "size_": words(F.col("text")),
            "block_": F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(blocks)),
            "key_": F.xxhash64(F.lit(seed + 1), "doc_id", "text")}


def _rank(block: Column, source: Column, turn, blocks: int, seed: int) -> Column:
    """Place of a block in the order of a pass: an affine permutation keyed by source and pass."""
    key = F.xxhash64(F.lit(seed + 2), source, F.lit(turn).cast("long") if isinstance(turn, int) else turn)
    factor = F.pmod(key, F.lit(blocks // 2)) * 2 + 1
    return F.pmod(factor * block + F.pmod(F.shiftrightunsigned(key, 32), F.lit(blocks)), F.lit(blocks))


def plan(docs: DataFrame, blocks: int = BLOCKS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row per source: source_, source_size_, target_, whole_ (passes), stop_rank_ and stop_key_
    (where the last pass ends), ends_ (per shard, the end of its stretch of draws).
    """
    slim = written(docs.select(*[c.alias(n) for n, c in _parts(blocks, seed).items()]), "mix-sizes")
    per_block = written(slim.groupBy("source_", "block_").agg(F.sum("size_").alias("words")), "mix-blocks")
    goals = written(targets(per_block.groupBy(F.col("source_").alias("source")).agg(
        F.sum("words").alias("source_size"))), "mix-targets")

    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goals = goals.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    same = F.col("s.source_").eqNullSafe(F.col("g.source"))
    ranked = per_block.alias("s").join(goals.alias("g"), same).select("s.*", "g.whole", "g.rest").withColumn(
        "rank", _rank(F.col("block_"), F.col("source_"), F.col("whole"), blocks, seed))
    order = Window.partitionBy("source_").orderBy("rank")
    ranked = ranked.withColumn("before", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"))
    # The first block that doesn't fit into the rest is taken in part.
    stop = written(ranked.where("words > rest - before").groupBy("source_").agg(
        F.min(F.struct("rank", "block_", (F.col("rest") - F.col("before")).alias("room"))).alias("m")).select(
        "source_", "m.*"), "mix-stop")

    same = F.col("s.source_").eqNullSafe(F.col("t.source_")) & (F.col("s.block_") == F.col("t.block_"))
    last = slim.alias("s").join(stop.alias("t"), same).groupBy("s.source_", "s.key_").agg(
        F.sum("s.size_").alias("size"), F.first("t.room").alias("room"))
    upto = F.sum("size").over(Window.partitionBy("source_").orderBy("key_").rowsBetween(Window.unboundedPreceding, 0))
    last = last.withColumn("upto", upto).where("room > 0 AND upto - size / 2 <= room")
    stop_key = last.groupBy("source_").agg(F.max("key_").alias("stop_key"))

    rows = goals.alias("g").join(stop.alias("t"), F.col("g.source").eqNullSafe(F.col("t.source_")), "left").join(
        stop_key.alias("k"), F.col("g.source").eqNullSafe(F.col("k.source_")), "left").select(
        "g.*", F.when(F.col("rest") > 0, F.coalesce("t.rank", F.lit(blocks))).otherwise(0).cast("long").alias("stop_rank"),
        "k.stop_key")
    rows = rows.withColumn("draws", F.col("whole") * blocks + F.col("stop_rank") + F.col("stop_key").isNotNull().cast("long"))

    def tree(frames):
        frame = pd.concat([*frames, pd.DataFrame({"draws": pd.Series(dtype="int64")})], ignore_index=True)
        if len(frame):
            frame = frame.sort_values("source", na_position="last", ignore_index=True)
            quotas = split_quotas(frame["draws"].to_numpy(dtype=np.int64), shards, seed)
            frame["ends"] = list(np.cumsum(quotas, axis=1))
            yield frame[names]

    names = [*rows.columns, "ends"]
    made = rows.coalesce(1).mapInPandas(tree, rows.withColumn("ends", F.array(F.lit(0).cast("long"))).schema)
    return written(made.drop("rest", "draws").toDF("source_", "source_size_", "target_", "whole_", "stop_rank_",
                                                   "stop_key_", "ends_"), "mix-plan")


def drawn(docs: DataFrame, blocks: int = BLOCKS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``docs`` with size_, source_size_, target_ and times_, how often the mix takes each row.

    ``docs`` needs doc_id, text and source; columns that end in ``_`` are the operator's own.
    """
    goals = plan(docs, blocks, shards, seed)
    d = docs.withColumns(_parts(blocks, seed))
    d = d.alias("d").join(goals.withColumnRenamed("source_", "plan_").alias("p"),
                          F.col("d.source_").eqNullSafe(F.col("p.plan_"))).drop("plan_")
    rank = _rank(F.col("block_"), F.col("source_"), F.col("whole_"), blocks, seed)
    more = (rank < F.col("stop_rank_")) | ((rank == F.col("stop_rank_")) & (F.col("key_") <= F.coalesce(
        "stop_key_", F.lit(-2**63))) & F.col("stop_key_").isNotNull())
    return d.withColumn("times_", (F.col("whole_") + more.cast("int")).cast("int"))


def _shard(turn: Column, blocks: int, seed: int) -> Column:
    """The output shard whose stretch of the source's draws, as the tree split them, holds a block's draw in a pass."""
    index = turn * blocks + _rank(F.col("block_"), F.col("source_"), turn, blocks, seed)
    return F.size(F.filter("ends_", lambda e: e <= index))


def shards_of(drawn_rows: DataFrame, blocks: int = BLOCKS, seed: int = SEED) -> DataFrame:
    """``drawn`` with shards_, the output shard of each of a row's takings."""
    passes = F.filter(F.sequence(F.lit(0).cast("long"), F.col("times_").cast("long")), lambda k: k < F.col("times_"))
    return drawn_rows.withColumn("shards_", F.transform(passes, lambda k: _shard(k, blocks, seed)))


def mixed(docs: DataFrame, blocks: int = BLOCKS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The mix: a row for each taking, with its shard_, sorted within shards in the mix's order."""
    d = drawn(docs, blocks, shards, seed).where("times_ > 0")
    d = d.withColumn("pass_", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times_").cast("long") - 1)))
    d = d.withColumn("shard_", _shard(F.col("pass_"), blocks, seed))
    d = d.withColumn("order_", F.xxhash64(F.lit(seed + 3), "key_", "pass_"))
    own = ["source_", "size_", "block_", "key_", "source_size_", "target_", "whole_", "stop_rank_", "stop_key_", "ends_", "times_"]
    return d.drop(*own)


def shuffled(mix: DataFrame) -> DataFrame:
    """The mix in its order: shards apart, each sorted locally."""
    return mix.repartition("shard_", F.pmod("order_", F.lit(16))).sortWithinPartitions("shard_", "order_")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text", source="source")
    # Besides the contract's columns: the shards that the tree gave the document's takings to.
    return shards_of(drawn(docs)).select("doc_id", F.col("size_").alias("size"), F.col("source_size_").alias("source_size"),
                              F.col("target_").alias("target"), (F.col("size_") * F.col("times_")).alias("taken"),
                              F.col("shards_").alias("shards"))
