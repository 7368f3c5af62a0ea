"""Source divergence, centroid clustering and sharding against brute force, with odd rows."""
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

from weblog.llm import clustering as cl
from weblog.llm import divergence as dv
from weblog.llm import sharding as sh

SF = "/root/testdata/sf0.001"


# --- source divergence ----------------------------------------------------------------

def brute_audit(rows, least, top=10):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        groups.add((lang, source))
        count[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang in {g[0] for g in groups}:
        kept = {t for t, n in docs[lang].items() if n >= least}
        own = {s: {t: n for t, n in count[lang, s].items() if t in kept} for x, s in groups if x == lang}
        whole = Counter()
        for c in own.values():
            whole.update(c)
        share = lambda c: {t: 1 + 10**9 * (c.get(t, 0) + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}  # noqa: E731, B023
        ps, q = {s: share(c) for s, c in own.items()}, share(whole)
        for s, p in ps.items():
            parts = {"pair": [(o, sum(f(p[t], r[t]) for t in kept)) for o, r in ps.items() if o != s],
                     "term": [(t, f(p[t], q[t])) for t in kept if own[s].get(t, 0) > 0 and p[t] > q[t]]}
            for part, items in parts.items():
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(items[:top] if part == "term" else items)]
    return sorted(out)


def audited(docs, **kw):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in dv.audit(docs, **kw).collect())


def test_audit_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(dv, "PIECE", 50)
    monkeypatch.setattr(dv, "HELD", 40)
    rng = np.random.default_rng(4)
    words = [f"{a}{b}" for a in "abcdeÄ" for b in ("x", "Y", "ß", "日")] + ["A", "zz"]
    rows = [(str(rng.choice(["en", "de"])), f"s{rng.integers(5)}", " ".join(rng.choice(words, rng.integers(0, 40)))) for _ in range(80)]
    rows += [(None, None, None), ("", None, "ax"), (None, "s", ""), ("fr", "only", "ax ax"), ("xx", "p", "rare"), ("xx", "q", None),
             ("en", "empty", "12 _ 3"), ("en", "s1", "aX-ax\x00ax " * 500), ("en", "é", "aa"), ("en", "Z", "日本"), rows[0], rows[0]]
    docs = spark.createDataFrame([Row(lang=a, source=b, text=t, TEXT="no", term=1) for a, b, t in rows],
                                 "lang string, source string, text string, TEXT string, term int")
    for block_rows in (1 << 16, 64):
        monkeypatch.setattr(dv, "BLOCK_ROWS", block_rows)
        assert audited(docs, least=3) == brute_audit(rows, 3)
    assert audited(docs, least=10**6) == brute_audit(rows, 10**6)  # no term is kept: pairs of value 0
    assert audited(docs.limit(0)) == []


def test_audit_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(dv, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(9)
    words = np.array([f"{chr(97 + i // 26)}{chr(97 + i % 26)}{c}" for i in range(600) for c in "q"])
    rows = [("en", f"s{rng.integers(4)}", " ".join(words[np.minimum(rng.zipf(1.3, 60) - 1, 599)])) for _ in range(400)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    assert audited(docs, least=2) == brute_audit(rows, 2)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), min_size=3, max_size=3), min_size=1, max_size=150))
def test_joint_cells_of_a_block(table):
    """Bitmaps of counts (terms x groups): AND and popcount with zeros by complement give the sum over all terms."""
    counts = np.array(table, dtype=np.int64)
    terms, groups = counts.shape
    bits = {}
    for t in range(terms):
        for g in range(groups):
            if counts[t, g]:
                k = (g, int(counts[t, g]), t // 64)
                bits[k] = bits.get(k, 0) | 1 << t % 64
    key = np.array(sorted(bits), dtype=np.int64).reshape(-1, 3)
    value = np.array([bits[tuple(k)] for k in key.tolist()], dtype=np.uint64)
    totals = counts.sum(axis=0) + 7
    got = dv.joint_values(key[:, 0], key[:, 1], key[:, 2], value, totals, terms, terms + 5)
    p = np.stack([dv.share(counts[:, g], totals[g], terms + 5) for g in range(groups)])
    for g in range(groups):
        for h in range(groups):
            assert got[g, h] == dv.distance(p[g], p[h]).sum()


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**12), st.integers(0, 10**15), st.integers(1, 10**9))
def test_shares_are_exact(count, more, terms):
    total = count + more
    assert int(dv.share(np.int64(count), np.int64(total), np.int64(terms))) == 1 + 10**9 * (count + 2) // (total + 2 * terms)


def test_share_column(spark):
    from pyspark.sql import functions as F
    cases = [(0, 0, 1), (5, 7, 3), (10**12, 10**15, 10**9), (999, 1000, 12345)]
    df = spark.createDataFrame(cases, "c long, t long, v long")
    got = df.select(dv.share_column(F.col("c"), F.col("t"), F.col("v")).alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (c + 2) // (t + 2 * v) for c, t, v in cases]


def test_pieces_are_cut_between_terms():
    raw = ("ab é日 " * 100).encode() + b"x" * 300
    parts = list(dv.pieces(raw, 37))
    assert b"".join(parts) == raw and len(parts) > 5
    assert Counter(t for p in parts for t in dv._TERM.findall(p)) == Counter(dv._TERM.findall(raw))
    assert list(dv.pieces(b"")) == [b""]


# --- centroid clustering ----------------------------------------------------------------

def brute_clusters(rows, k, rounds, dim, scale=1024, seed=3):
    x = [(i, [int(np.floor(scale * float(v))) for v in e]) for i, e in rows
         if e is not None and len(e) == dim and all(v is not None and np.isfinite(v) for v in e)]
    key = lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [list(r[1]) for r in sorted(x, key=key)[:k]]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    near = lambda v: min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c))
    for _ in range(rounds):
        of = [near(v) for _, v in x]
        for c in range(len(centroids)):
            own = [v for (_, v), o in zip(x, of) if o == c]
            if own:
                centroids[c] = [sum(col) // len(own) for col in zip(*own)]
    return [(i, near(v), far(v, centroids[near(v)])) for i, v in x], centroids


def srt(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_clusters_of_odd_rows(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(v)) for v in rng.normal(size=4)]) for i in range(60)]
    rows += [(100, None), (101, [1.0] * 3), (102, [1.0, None, 1.0, 1.0]), (103, [float("nan")] * 4), (104, [float("inf"), 0.0, 0.0, 0.0]),
             (None, [0.0] * 4), (5, rows[5][1]), (6, rows[7][1]), (105, []), (106, [-0.0] * 4), *[(200 + i, [2.0] * 4) for i in range(30)]]
    df = spark.createDataFrame([Row(vec_id=i, embedding=e, x="no", VEC_ID="n") for i, e in rows],
                               "vec_id long, embedding array<float>, x string, VEC_ID string")
    for k, rounds in ((8, 4), (1, 2), (500, 2)):
        want, centroids = brute_clusters(rows, k, rounds, 4)
        found, got = cl.cluster(df, k=k, rounds=rounds, dim=4)
        assert got.tolist() == centroids
        assert srt(tuple(r) for r in found.collect()) == srt(want)
    found, got = cl.cluster(df.limit(0), dim=4)
    assert found.count() == 0 and len(got) == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(*[st.integers(-3, 3)] * 2), min_size=1, max_size=6),
       st.lists(st.tuples(*[st.integers(-3, 3)] * 2), min_size=1, max_size=20))
def test_tournament_ties_go_to_the_smaller_number(centroids, points):
    c, x = np.array(centroids, dtype=np.int64), np.array(points, dtype=np.int64)
    far = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert cl.champions(x, *cl.bisectors(c)).tolist() == far.argmin(axis=1).tolist()


def test_a_component_too_large_is_refused(spark):
    df = spark.createDataFrame([(1, [1e9, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="squared distances"):
        cl.integers(df, dim=2).collect()


# --- sharding ----------------------------------------------------------------

def contract(rows, got, shards=8):
    """The law ``rows``: counts at most one apart, slots gapless, every row once."""
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == sorted(
        ((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows), key=repr)
    slots = defaultdict(list)
    for r in got:
        assert r.law == "rows" and r.grown_shard is None
        slots[r.shard].append(r.slot)
    counts = [len(slots.get(s, [])) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and set(slots) <= set(range(shards))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards_of_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sh.op13_sharding(spark, SF).collect()
    contract(rows, got)
    assert srt(map(tuple, got)) == srt(map(tuple, sh.op13_sharding(spark, SF).collect()))
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert abs(np.corrcoef(np.arange(len(order)), order)[0, 1]) < 0.25


def test_shards_of_odd_rows(spark, tmp_path):
    rows = [(7, "same")] * 400 + [(None, None)] * 5 + [(i, "ä" * (i % 50)) for i in range(300)] + [(9, "long " * 20000), (10, "")]
    docs = spark.createDataFrame([Row(doc_id=i, text=t, shard="s", Text=1, n=i) for i, t in rows],
                                 "doc_id long, text string, shard string, Text int, n long").repartition(3)
    made = sh.sharded(docs, bucket_bytes=2000)
    assert made.columns == ["doc_id", "text", "shard", "Text", "n", "shard", "slot"]
    back = made.toDF("doc_id", "text", "s", "T", "n", "shard", "slot").collect()
    assert len(back) == len(rows) and all(r.s == "s" for r in back)
    counts = Counter(r.shard for r in back)
    assert max(counts.values()) - min(counts.values()) <= 1
    hot = Counter(r.shard for r in back if r.doc_id == 7)  # copies spread
    assert len(hot) == 8 and max(hot.values()) < 90
    few = sh.sharded(docs.limit(3)).toDF("doc_id", "text", "s", "T", "n", "shard", "slot").collect()
    assert len({r.shard for r in few}) == 3 and {r.slot for r in few} == {0}
    assert sh.sharded(docs.limit(0)).count() == 0


def test_buckets_are_shuffled_as_stated(spark, tmp_path):
    """A plain version: hash, bucket, order, permutation by bucket, even stretches."""
    from pyspark.sql import functions as F
    path = str(tmp_path / "docs")
    spark.range(500).selectExpr("id AS doc_id", "repeat('x', int(id % 40)) AS text").repartition(4).write.parquet(path)
    docs = spark.read.parquet(path)
    buckets = -(-sum(r.n for r in docs.selectExpr("length(text) + 1 AS n").collect()) // 700)
    plain = docs.select("doc_id", F.element_at(F.split("_metadata.file_path", "/"), -1).alias("f"), F.col("_metadata.row_index").alias("row"))
    plain = plain.withColumn("h", F.xxhash64(F.lit(13), "doc_id", "f", "row"))
    plain = plain.withColumn("b", F.pmod(F.xxhash64(F.lit(14), "h"), F.lit(buckets))).collect()
    order = []
    for b in range(buckets):
        own = sorted((r.h, r.row, r.doc_id) for r in plain if r.b == b)
        order += [own[i][2] for i in np.random.Generator(np.random.Philox(key=[13, b])).permutation(len(own))]
    got = sh.sharded(docs, bucket_bytes=700).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))] == order and buckets > 10


def test_written_shards(spark, tmp_path):
    docs = spark.range(100).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    sh.write_shards(docs, str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {r.shard: r["count"] for r in back.groupBy("shard").count().collect()} == {s: 25 for s in range(4)}
    assert back.select("doc_id").distinct().count() == 100
