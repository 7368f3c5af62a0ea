import hashlib
import re
from collections import Counter

import corpus_pipeline as cp
from tests.llm.test_bpe import library
from tests.llm.test_near_dedup import brute
from weblog.llm.common import written

SF = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "exact dedup", "near dedup", "source mixing", "byte-level BPE"]
    steps, given = {}, docs
    for name, stage in cp.STAGES:
        given = written(stage(spark, given, SF), "pipeline-test")
        steps[name] = given
        if name != "byte-level BPE":
            assert given.columns == cp.COLUMNS
    rows = {n: [tuple(r) for r in d.select("doc_id", "text").collect()] for n, d in steps.items() if n != "byte-level BPE"}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {i for i, _ in rows["quality classifier"]}
    good = [i for i, y in labels.items() if y]
    assert sum(i in kept for i in good) >= 0.97 * len(good)
    assert sum(i in kept for i, y in labels.items() if not y) <= 0.1 * len(labels)

    best = {}
    for i, t in rows["quality classifier"]:
        key = re.sub(r"[\x20\x09-\x0d]", "", t)
        best[key] = min(best.get(key, (0, i, t)), (-len(t), i, t))
    assert sorted(rows["exact dedup"]) == sorted((i, t) for _, i, t in best.values())

    groups = brute(rows["exact dedup"], 5)
    assert sorted(i for i, _ in rows["near dedup"]) == sorted(d for d, _, c in groups if d == c)

    taken = Counter(i for i, _ in rows["source mixing"])
    assert set(taken) <= {i for i, _ in rows["near dedup"]} and max(taken.values()) <= 3
    text, lib = dict(rows["near dedup"]), library()
    out = steps["byte-level BPE"].collect()
    assert Counter(r.doc_id for r in out) == taken
    for r in out:
        assert r.ids == lib.encode_ordinary(text[r.doc_id]) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_stages_take_empty_and_odd_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0),
                                 (None, "a b c", "en", None, 5), (3, "w " * 50000, "en", "s", 100000)], schema)
    for docs in (odd.limit(0), odd):
        for _, stage in cp.STAGES:
            assert stage(spark, docs, SF).count() <= 3 * docs.count()
