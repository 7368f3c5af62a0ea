import hashlib
import re

import numpy as np
from pyspark.sql import Row

from weblog.llm import fingerprint as fp

SF = "/root/testdata/sf0.001"


def shingles(text, n=5):
    w = [x.lower() if x.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), x)
         for x in re.findall(r"[^\x20\x09-\x0d]+", text or "")]
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def check(docs, got):
    """Against the definition on ordered rows."""
    order = sorted(docs, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = []
    for i, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        k = len(text) // 3
        new = text[:len(text) - k] + after[:k]
        want.append((doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), jaccard(text, new), jaccard(text, after)))
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2])
    rows = sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got), key=key)
    want.sort(key=key)
    assert [r[:3] for r in rows] == [w[:3] for w in want]
    off = np.array([[r[3] - w[3], r[4] - w[4]] for r, w in zip(rows, want)])
    assert np.abs(off).max() < 0.35 and np.abs(off).mean() < 0.05


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = fp.op8_fingerprint(spark, SF).collect()
    check([tuple(r) for r in docs.collect()], got)
    by_text = {}
    text = dict(tuple(r) for r in docs.collect())
    for r in got:
        assert by_text.setdefault(text[r.doc_id], r.fingerprint) == r.fingerprint


def test_odd_rows(spark):
    rows = [Row(doc_id=5, text="a b c d e f g", fingerprint=1), Row(doc_id=5, text="a b c d e f g", fingerprint=1),
            Row(doc_id=None, text="x", fingerprint=1), Row(doc_id=3, text=None, fingerprint=1),
            Row(doc_id=-2, text="é" * 10, fingerprint=1), Row(doc_id=2**62, text="w " * 50000, fingerprint=1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint int")
    for stretches in (1, 2, 4):
        check([(r.doc_id, r.text) for r in rows], fp.compared(docs, stretches).collect())
    one = fp.compared(docs.where("doc_id = 3")).collect()
    assert (one[0].near_edited, one[0].near_next, one[0].fingerprint) == (1.0, 1.0, "empty")
    assert fp.compared(docs.limit(0)).count() == 0


def test_links_are_the_pairs_above_the_threshold(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    member = {r.doc_id: r.class_id for r in fp.sets(docs).select("doc_id", "class_id").collect()}
    text = {member[r.doc_id]: r.text for r in docs.collect() if r.doc_id in member}
    ids = sorted(text)
    want = {(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if jaccard(text[a], text[b]) >= 0.8}
    got = {(r.a, r.b) for r in fp.links(docs).collect()}
    assert want and got <= want and len(got) >= 0.95 * len(want)
