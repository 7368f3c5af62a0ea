import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weblog.operators import matching
from weblog.operators.matching import assert_equal, mismatches


def frame(spark, rows, schema="k string, x double"):
    return spark.createDataFrame(rows, schema)


def found(spark, a, b, schema="k string, x double", **kw):
    return mismatches(frame(spark, a, schema), frame(spark, b, schema), **kw).collect()


def test_the_boundary_of_the_tolerance(spark):
    # 1e9 and 1e9 + 1 agree, and so do 1e-8 and 1.5e-8 by atol; 1e-5 off 100 is the last that does.
    same = [("a", 1e9), ("b", 100.0), ("c", 1e-8), ("d", 0.0), ("e", -5.0)]
    near = [("a", 1e9 + 1), ("b", 100.0009), ("c", 1.5e-8), ("d", -0.0), ("e", -5.00004)]
    assert found(spark, near, same) == []
    assert_equal(frame(spark, near), frame(spark, same))
    off = found(spark, [("b", 100.0011), ("e", -5.00006)], [("b", 100.0), ("e", -5.0)])
    assert sorted((r.k, r.left.x, r.right.x, r.copies) for r in off) == [("b", 100.0011, 100.0, 1), ("e", -5.00006, -5.0, 1)]
    with pytest.raises(AssertionError, match="100.0011"):
        assert_equal(frame(spark, [("b", 100.0011)]), frame(spark, [("b", 100.0)]))


def test_null_nan_and_infinity(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(None, None), ("a", nan), ("a", inf), ("a", -inf), ("b", None)]
    assert found(spark, odd, list(reversed(odd))) == []
    off = found(spark, [("a", nan), ("b", None), ("c", inf)], [("a", 1.0), ("b", 0.0), ("c", 1e300)])
    assert sorted(r.k for r in off) == ["a", "b", "c"] and all(r.left and r.right for r in off)


def test_surplus_copies_are_counted_not_exploded(spark):
    left = spark.range(3_000_000).selectExpr("'k' AS k", "1.0D AS x")
    right = spark.range(2_999_990).selectExpr("'k' AS k", "1.000001D AS x").unionByName(frame(spark, [("k", 2.0)] * 4))
    off = {(r.left.x if r.left else None, r.right.x if r.right else None): r.copies for r in mismatches(left, right).collect()}
    assert off == {(1.0, 2.0): 4, (1.0, None): 6}


def test_exact_columns_and_dtypes(spark):
    a = spark.createDataFrame([(1, "x", 2)], "i int, s string, v long")
    b = spark.createDataFrame([(2.00001, "x", 1)], "v double, s string, i long")
    assert mismatches(a, b).collect() == []
    assert len(found(spark, [(1, "x"), (1, "x")], [(1, "x"), (1, "y")], "i int, s string")) == 2
    with pytest.raises(ValueError, match="column sets differ"):
        mismatches(a, b.drop("v"))
    empty = frame(spark, [])
    assert mismatches(empty, empty).collect() == []
    assert [(r.k, r.left, r.copies) for r in mismatches(empty, frame(spark, [("a", 1.0)])).collect()] == [("a", None, 1)]


def test_noise_in_the_first_double_column(spark):
    a = [("k", 1.0, 5.0), ("k", 1.0 + 1e-9, 3.0)]
    b = [("k", 1.0 + 1e-9, 5.0), ("k", 1.0, 3.0)]
    assert found(spark, a, b, "k string, x double, y double") == []
    off = found(spark, a, [("k", 1.0, 5.0), ("k", 1.0, 4.0)], "k string, x double, y double")
    assert [(r.left.y, r.right.y) for r in off] == [(3.0, 4.0)]


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    """One hot group over many stretches; matching sorted copies one by one is optimal for one column."""
    rng = random.Random(seed)
    def values(n):
        return [("hot" if rng.random() < 0.7 else rng.choice("abc"), round(rng.choice([1.0, 2.0, 50.0]) * (1 + rng.choice([0, 0, 4e-6, 3e-5])), 9))
                for _ in range(n)]
    a, b = values(300), values(290)
    want = Counter()
    for k in {x[0] for x in a + b}:
        xs, ys = sorted(x for j, x in a if j == k), sorted(y for j, y in b if j == k)
        for i in range(max(len(xs), len(ys))):
            x, y = xs[i] if i < len(xs) else None, ys[i] if i < len(ys) else None
            if x is None or y is None or not math.isclose(x, y, rel_tol=0, abs_tol=1e-8 + 1e-5 * abs(y)):
                want[k, x, y] += 1
    got = Counter()
    for r in found(spark, a, b, stretch=7):
        got[r.k, r.left.x if r.left else None, r.right.x if r.right else None] += r.copies
    assert got == want


def test_a_hot_group_is_ranked_in_many_partitions(spark):
    rows = spark.range(20000).selectExpr("struct('k' AS k) AS _key", "array(cast(id AS double)) AS _v", "id % 2 AS _side", "1L AS _n")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # keeps small ranges apart, too
    try:
        parts = rows.repartitionByRange("_key", "_v", "_side").groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in parts) < 10000
        ranks = sorted((r._side, r._start, r._v[0]) for r in matching._ranked(rows, F.col("_v")).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ranks == [(s, i, float(2 * i + s)) for s in (0, 1) for i in range(10000)]
