import re
from collections import Counter

import numpy as np
from pyspark.sql import Row

from weblog.llm import mixing as mx

SF = "/root/testdata/sf0.001"


def fill(sizes):
    """Targets by repeated resharing of the excess."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    out, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 3 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def check(rows, got, near):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
    total = Counter()
    for r in rows:
        total[r.source] += size(r.text)
    want, taken = fill(total), Counter()
    assert len(got) == len(rows)
    of = {}
    for r in rows:
        of.setdefault((r.doc_id, size(r.text)), r.source)
    for r in got:
        s = of[(r.doc_id, r.size)]
        assert r.source_size == total[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= near.get(s, 0) + 1e-6, (s, taken[s], t)
    return want


def rows_of(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()


def test_whole_table(spark):
    rows = rows_of(spark, SF)
    longest = {}
    for r in rows:
        longest[r.source] = max(longest.get(r.source, 0), len((r.text or "").split()))
    got = mx.op4_mixing(spark, SF).collect()
    check(rows, got, longest)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mx.op4_mixing(spark, SF).collect()))
    assert all(len(r.shards) * r.size == r.taken and set(r.shards) <= set(range(mx.SHARDS)) for r in got)


def test_odd_sources(spark):
    rows = [Row(doc_id=i, text="w " * (i % 7), source=s, size=1, plan=2) for i, s in
            enumerate(["b"] * 300 + ["a"] * 3 + [None] * 50 + ["é"] * 20 + ["empty"] * 2)]
    rows = [r if r.source != "empty" else Row(doc_id=r.doc_id, text=None, source="empty", size=1, plan=2) for r in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, plan int")
    d = mx.drawn(docs).selectExpr("doc_id", "size_ AS size", "source_size_ AS source_size", "target_ AS target",
                                  "size_ * times_ AS taken").collect()
    want = check(rows, d, dict.fromkeys(["a", "b", None, "é", "empty"], 7))
    assert want["a"] == 3 * sum(i % 7 for i in range(300, 303))
    assert mx.drawn(docs.limit(0)).count() == 0
    one = mx.drawn(docs.where("doc_id = 5")).first()
    assert (one.target_, one.times_) == (5.0, 1)


def test_mix_is_what_was_drawn(spark):
    docs = spark.createDataFrame(rows_of(spark, SF))
    drawn = {r.doc_id: r.times_ for r in mx.drawn(docs).collect()}
    mix = mx.shuffled(mx.mixed(docs))
    rows = mix.collect()
    assert Counter(r.doc_id for r in rows) == Counter({k: v for k, v in drawn.items() if v})
    assert {r.shard_ for r in rows} <= set(range(mx.SHARDS)) and set(docs.columns) <= set(mix.columns)
    told = Counter((r.doc_id, s) for r in mx.shards_of(mx.drawn(docs)).collect() for s in r.shards_)
    assert told == Counter((r.doc_id, r.shard_) for r in rows)


def test_tree_splits_all_quotas_evenly():
    draws = np.array([5000, 100, 0, 3000, 1])
    out = mx.split_quotas(draws, 13, 1)
    assert (out.sum(axis=1) == draws).all() and (out >= 0).all()
    per = out.sum(axis=0)
    assert per.max() - per.min() <= 13
    share = out[0] / per
    assert abs(share - draws[0] / draws.sum()).max() < 0.08
    assert (mx.split_quotas(draws, 13, 1) == out).all() and (mx.split_quotas(draws, 13, 2) != out).any()


def test_ranks_permute_the_blocks(spark):
    from pyspark.sql import functions as F
    for turn in range(3):
        rows = spark.range(64).select(mx._rank(F.col("id"), F.lit("s"), turn, 64, 9).alias("r")).collect()
        assert sorted(r.r for r in rows) == list(range(64))
