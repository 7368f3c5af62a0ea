import hashlib
import re

from pyspark.sql import Row
from pyspark.sql import functions as F

from weblog.llm import exact_dedup as ed
from weblog.session import scratch_dir


def norm(t):
    return re.sub(r"[\x20\x09-\x0d]", "", t or "")


def rows():
    given = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, "a b "), (5, None), (6, ""), (7, " \n"), (8, "A b"), (9, "é x"),
             (10, "é  x"), (None, "a\tb  "), (None, None), (2, "ab"), (2, "other"), (11, "y" * 200000), (12, "y " * 200000),
             (13, "\x1cz"), (14, "z")]
    return [Row(doc_id=i, text=t, digest="x", file="y", row=1, TEXT="z") for i, t in given]


def frame(spark, given):
    return spark.createDataFrame(given, "doc_id long, text string, digest string, file string, row int, TEXT string")


def want(given):
    groups = {}
    for r in given:
        groups.setdefault(norm(r.text), []).append(r)
    out = []
    for r in given:
        g = groups[norm(r.text)]
        best = min(g, key=lambda x: (-len(x.text or ""), x.doc_id is None, x.doc_id or 0))
        out.append((r.doc_id, best.doc_id, len(g), hashlib.sha256(norm(r.text).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()), key=repr)


def test_groups(spark):
    given = rows()
    out = ed.dedup(frame(spark, given))
    assert got(out) == want(given)
    kept = [r for r in out.collect() if r.kept]
    assert len(kept) == len({norm(r.text) for r in given})


def test_equal_digests_are_only_hits(spark):
    """With a digest of four values nearly all texts collide, and bytes decide."""
    given = rows()
    weak = lambda norm: F.substring(F.sha2(norm, 256), 1, 1).substr(1, 1).isin(*"01234567").cast("string")
    assert got(ed.dedup(frame(spark, given), digest=weak)) == want(given)


def test_state_goes_on_where_it_ended(spark, tmp_path):
    given = rows()
    docs = ed.located(frame(spark, given[:8]))
    path, state = scratch_dir(spark, "dedup-test") + "/r", scratch_dir(spark, "dedup-test-state")
    first = ed.records(docs)
    first.write.parquet(path)
    ed.stream_state(first, path, state)
    ed.records(ed.located(frame(spark, given[8:]))).write.mode("append").parquet(path)
    slim = spark.read.schema(first.schema).parquet(path)
    out = ed.stream_state(slim, path, state, files_per_batch=1)
    sizes = {}
    for r in given:
        sizes[norm(r.text)] = sizes.get(norm(r.text), 0) + 1
    assert sorted(r.group_size for r in out.collect()) == sorted(sizes.values())


def test_unique_and_empty(spark):
    given = rows()
    kept = ed.unique(frame(spark, given))
    assert kept.columns == ["doc_id", "text", "digest", "file", "row", "TEXT"]
    assert kept.count() == len({norm(r.text) for r in given})
    assert ed.dedup(frame(spark, given).limit(0)).count() == 0
