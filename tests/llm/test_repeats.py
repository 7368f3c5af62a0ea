import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row

from weblog.llm import repeats

SF = "/root/testdata/sf0.001"


def brute(texts, length):
    """For each text (bytes) the flags of the bytes that go."""
    count = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        flag = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - length + 1):
            if count[t[i:i + length]] > 1:
                flag[i:i + length] = True
        out.append(flag)
    return out


def expected(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    out = []
    for (doc_id, _), t, flag in zip(rows, texts, brute(texts, length)):
        runs = int(np.sum(np.diff(np.concatenate([[0], flag.astype(int)])) == 1))
        out.append((doc_id, len(t), int(flag.sum()), runs, bytes(np.frombuffer(t, dtype=np.uint8)[~flag])))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", range(6))
def test_index_finds_repeated_windows(seed):
    rng = random.Random(seed)
    pieces = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 60))) for _ in range(20)] + [b"a" * 50, b"ab" * 30, b""]
    for length in (3, 8, 13, 29):
        given = [p for p in pieces if len(p) >= length]
        count = Counter(p[i:i + length] for p in given for i in range(len(p) - length + 1))
        for p, flags in zip(given, repeats.repeated_windows(given, length)):
            assert [count[p[i:i + length]] > 1 for i in range(len(p) - length + 1)] == flags.tolist()


@pytest.mark.parametrize("seed", range(4))
def test_contexts_cover_every_window_once(seed):
    rng = random.Random(seed)
    texts = [bytes(rng.choice(b"abc" if seed % 2 else b"a") for _ in range(rng.randrange(0, 200))) for _ in range(30)]
    ends = np.cumsum([len(t) for t in texts])
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    text, start, count, anchor, content, check, inner = repeats.contexts(raw, ends, 20, 4)
    seen = sorted((int(t), int(s) + i) for t, s, c in zip(text, start, count) for i in range(c))
    first = np.concatenate([[0], ends[:-1]])
    assert seen == [(t, int(f) + i) for t, (f, x) in enumerate(zip(first, texts)) for i in range(max(0, len(x) - 19))]
    of, of_content = {}, {}
    for s, c, a, k, x, own in zip(start, count, anchor, content, check, inner):
        b = raw[s:s + c + 19].tobytes()
        assert of_content.setdefault(b, (int(k), int(x))) == (k, x)
        windows = [b[i:i + 20] for i in range(c)]
        assert own or len(set(windows)) == len(windows)
        for w in windows:
            assert of.setdefault(w, int(a)) == a


def odd_rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 8)))
    passage = " ".join(word() for _ in range(12))
    rows = [(i, " ".join(word() for _ in range(rng.randrange(0, 60))) + (passage if i % 3 == 0 else "") + word()) for i in range(60)]
    return rows + [(100, None), (None, ""), (101, "x" * 500), (102, "x" * 39), (103, "ab" * 300), (7, rows[5][1]), rows[9], rows[9],
                   (None, passage + "é" * 40), (None, "é" * 60), (104, passage * 3), (105, "Und " * 400)]


def test_odd_rows_both_ways(spark):
    rows = odd_rows()
    docs = spark.createDataFrame([Row(doc_id=i, text=t, anchor=1, TEXT="") for i, t in rows],
                                 "doc_id long, text string, anchor int, TEXT string")
    want = expected(rows, 40)
    assert sum(w[2] for w in want) > 1000
    assert rows_of(repeats.cut(docs, 40, 8)) == want
    assert rows_of(repeats.cut(docs, 40, 8, hot_bytes=0)) == want  # every window counted
    assert rows_of(repeats.cut(docs, 40, 4, hot_bytes=0)) == want  # longer anchors first
    assert rows_of(repeats.cut(docs, 40, 4, hot_bytes=3000)) == want  # some of each
    assert repeats.cut(docs.limit(0)).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    import hashlib
    want = sorted((w[0], w[1], w[2], w[3], hashlib.sha256(w[4]).hexdigest()) for w in expected(rows, repeats.LENGTH))
    rows = repeats.op3_repeats(spark, SF).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == want and sum(w[2] for w in want) > 0
    assert {r.doc_id: r.text for r in rows} == {w[0]: w[4].decode("utf-8", "replace") for w in expected(
        [tuple(r) for r in docs.collect()], repeats.LENGTH)}


def test_two_thousand_rows_without_id(spark):
    rows = [(None, f"row {i} " + ("shared words " * 8 if i % 2 else "") + f"end {i}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(repeats.cut(docs, 40, 8)) == expected(rows, 40)
