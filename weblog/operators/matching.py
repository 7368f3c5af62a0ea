"""Frame equality under a relative tolerance, as a distributed multiset match.

Two frames are equal if their rows can be paired so that every exact column agrees and every
pair of doubles is within ``atol + rtol * |right|``. Rows are matched by rank:

1. Equal rows collapse to one row with a count, map-side; nothing is ever made per copy.
2. Rows with the same exact columns are ranked by their doubles, each side for itself. A row with n copies covers
   n ranks. For this the rows are range-partitioned by (exact columns, doubles) and written, so a group that
   holds most rows (or all: frames of doubles only) lies in many partitions; a partition's ranks start where the
   counts of the partitions before end.
3. Rank space is cut into stretches of ``STRETCH`` ranks. Inside a stretch the intervals of the two sides
   are laid over each other: each elementary interval pairs one left with one right value, or has one side only.
4. Pairs outside the tolerance are left over. With several double columns, noise in the first one may have put rows in
   another order, so the left-over rows are matched again with each other column first.

With one double column a match by rank finds a pairing if there is one. With several it is sound but greedy:
what it pairs is within tolerance, and rows whose doubles all lie close to those of other rows
with the same exact columns may be reported although some pairing exists; name columns that tell rows
apart as exact ones then (cast them to another type).

Null matches null only, NaN matches NaN only, an infinity only itself. Integers meet doubles as doubles. Columns match by name; map columns can't be compared.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from weblog.session import scratch_dir

#: Ranks that one window group lays over each other.
STRETCH = 1 << 16
#: The tolerances of a usual frame comparison.
RTOL, ATOL = 1e-5, 1e-8


def _staged(df: DataFrame) -> DataFrame:
    """Written below the shared scratch folder and read back: a repeated read sees the same partitions."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark, 'match')}/rows"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _within(a: Column, b: Column, rtol: float, atol: float) -> Column:
    inf = F.lit(float("inf"))
    near = (F.abs(a) < inf) & (F.abs(b) < inf) & (F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b))
    return F.coalesce(a.eqNullSafe(b) | near, F.lit(False))


def _ranked(rows: DataFrame, order: Column) -> DataFrame:
    """Adds ``_start``: copies of the rows of the same key and side that come before, by ``order``, then ``_v``."""
    rows = _staged(rows.withColumn("_order", order).repartitionByRange("_key", "_order", "_v", "_side")
                   .withColumn("_part", F.spark_partition_id()))
    sums = rows.groupBy("_key", "_side", "_part").agg(F.sum("_n").alias("_sum"))
    before = Window.partitionBy("_key", "_side").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("_key", "_side", "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_key", "_side", "_part").orderBy("_order", "_v").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    return rows.join(bases, ["_key", "_side", "_part"]).select(
        "_key", "_side", "_v", "_n", (F.col("_base") + F.col("_inside")).alias("_start"))


def _laid_over(ranked: DataFrame, stretch: int) -> DataFrame:
    """_key, _left, _right (arrays of doubles, null where a side has no more rows), _n."""
    div = lambda c: F.call_function("div", c, F.lit(stretch).cast("long"))
    span = F.struct((F.col("_start") + F.col("_n")).alias("end"), F.col("_v").alias("v"))
    ends = ranked.groupBy("_key", "_side").agg(F.max(F.col("_start") + F.col("_n")).alias("_start")).select(
        "_key", "_side", "_start", div(F.col("_start")).alias("_stretch"),
        F.struct(F.col("_start").alias("end"), F.lit(None).cast("array<double>").alias("v")).alias("_span"))
    events = ranked.select(
        "_key", "_side", "_start", F.explode(F.sequence(div(F.col("_start")), div(F.col("_start") + F.col("_n") - 1))).alias("_stretch"),
        span.alias("_span"))
    events = events.unionByName(ends).withColumn(
        "_at", F.greatest("_start", F.col("_stretch") * F.lit(stretch).cast("long")))
    of = lambda side: F.max(F.when(F.col("_side") == side, F.col("_span")))
    events = events.groupBy("_key", "_stretch", "_at").agg(of(0).alias("_l"), of(1).alias("_r"))
    w = Window.partitionBy("_key", "_stretch").orderBy("_at")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    segments = events.select(
        "_key", "_at", F.last("_l", ignorenulls=True).over(so_far).alias("_l"),
        F.last("_r", ignorenulls=True).over(so_far).alias("_r"),
        F.coalesce(F.lead("_at").over(w), (F.col("_stretch") + 1) * F.lit(stretch).cast("long")).alias("_to"))
    there = lambda s: F.coalesce(F.col(f"{s}.end") > F.col("_at"), F.lit(False))
    segments = segments.where(there("_l") | there("_r"))
    return segments.select("_key", F.when(there("_l"), F.col("_l.v")).alias("_left"),
                           F.when(there("_r"), F.col("_r.v")).alias("_right"), (F.col("_to") - F.col("_at")).alias("_n"))


def mismatches(left: DataFrame, right: DataFrame, rtol: float = RTOL, atol: float = ATOL, stretch: int = STRETCH) -> DataFrame:
    """Rows that have no partner within the tolerance: the exact columns, ``left`` and ``right`` (structs of
    the double columns; null where that side has no row left) and ``copies``. Empty if the frames are equal.

    Runs jobs while it is built (rows are staged in the shared scratch folder).
    """
    if sorted(left.columns) != sorted(right.columns):
        raise ValueError(f"column sets differ: {sorted(left.columns)} vs {sorted(right.columns)}")
    cols = sorted(left.columns)
    real = [c for c in cols if any(isinstance(d.schema[c].dataType, (DoubleType, FloatType)) for d in (left, right))]
    exact = [c for c in cols if c not in real]

    def side(df: DataFrame, number: int) -> DataFrame:
        values = F.array(*[F.col(c).cast("double") + F.lit(0.0) for c in real]).cast("array<double>")
        return df.select(*exact, values.alias("_v"), F.lit(number).alias("_side"))

    both = side(left, 0).unionByName(side(right, 1))
    both = both.select(F.struct(*exact, F.lit(0).alias("_one")).alias("_key"), "_v", "_side")
    rows = both.groupBy("_key", "_side", "_v").agg(F.count(F.lit(1)).alias("_n"))
    for first in range(max(1, len(real))):
        order = F.array(*[F.get("_v", F.lit((first + i) % len(real))) for i in range(len(real))]).cast("array<double>")
        pairs = _laid_over(_ranked(rows, order), stretch)
        both_there = F.col("_left").isNotNull() & F.col("_right").isNotNull()
        good = both_there
        for i in range(len(real)):
            good = good & _within(F.get("_left", F.lit(i)), F.get("_right", F.lit(i)), rtol, atol)
        pairs = pairs.where(~good).groupBy("_key", "_left", "_right").agg(F.sum("_n").alias("_n"))
        if first + 1 < len(real):
            pairs = _staged(pairs)
            if pairs.where("_left IS NOT NULL").isEmpty() or pairs.where("_right IS NOT NULL").isEmpty():
                break
            rows = pairs.select("_key", "_n", F.posexplode(F.array("_left", "_right")).alias("_side", "_v")).where("_v IS NOT NULL")
            rows = rows.groupBy("_key", "_side", "_v").agg(F.sum("_n").alias("_n"))
    shown = lambda s: F.when(F.col(s).isNotNull(), F.struct(
        *[F.get(s, F.lit(i)).alias(c) for i, c in enumerate(real)], *([] if real else [F.lit(True).alias("there")])))
    return pairs.select(*[F.col(f"_key.{c}").alias(c) for c in exact], shown("_left").alias("left"),
                        shown("_right").alias("right"), F.col("_n").alias("copies"))


def assert_equal(left: DataFrame, right: DataFrame, rtol: float = RTOL, atol: float = ATOL, shown: int = 5) -> None:
    """Raise AssertionError with a few mismatches unless the frames are equal within the tolerance."""
    found = mismatches(left, right, rtol, atol).limit(shown).collect()
    if found:
        raise AssertionError("frames differ: " + "; ".join(str(r.asDict(recursive=True)) for r in found))
