import base64
import hashlib
import random
import time

import numpy as np
import tiktoken
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

from weblog.llm import bpe

PATH, PATTERN = bpe.public_vocabulary()


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(1)
    odd = [" ", "  ", "\n", "\t", "a", "ab", "'s", "é", "日本語", "1", "23", "!", "!!", " ", "\x1c", "　", "🙂", "\x00"]
    made = ["".join(rng.choice(odd) for _ in range(rng.randrange(0, 30))) for _ in range(400)]
    return made + ["", " ", "a" * 3000, "ab" * 2000, "é" * 700, "".join(rng.choice("abcdefgh") for _ in range(5000)),
                   "foo \n  bar", "foo   bar", "x  y\n z ", "It's we'll I'd", "<|endoftext|> </s>"]


def test_coder_agrees_with_the_library():
    own, lib = bpe.coder(PATH, PATTERN), library()
    some = texts()
    coded = own.encode(some)
    for t, c in zip(some, coded):
        assert np.frombuffer(c, "<u4").tolist() == lib.encode_ordinary(t), repr(t[:60])
    assert own.decode(coded) == [t.encode() for t in some]


def test_both_queries_agree(monkeypatch):
    some = [t for t in texts() if t]
    short = bpe.Coder(PATH, PATTERN)
    words = list({w for t in some for w in short.split(t)})
    words = [w for w in words if len(w) < 900]
    monkeypatch.setattr(bpe, "LONG", 0)
    some = words[:150]
    long = bpe.Coder(PATH, PATTERN).words(some)
    monkeypatch.setattr(bpe, "LONG", 10**9)
    assert short.words(some) == long


def test_rows(spark):
    rows = [Row(doc_id=1, text="Hello hello", n_tokens="x", TEXT="no"), Row(doc_id=2, text=None, n_tokens=None, TEXT=None),
            Row(doc_id=None, text="", n_tokens="", TEXT=""), Row(doc_id=1, text="Hello hello", n_tokens="x", TEXT="no")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, TEXT string")
    got = bpe.tokenize(docs).collect()
    assert len(got) == 4
    empty = hashlib.sha256(b"").hexdigest()
    ids = library().encode_ordinary("Hello hello")
    for r in got:
        if r.doc_id == 1:
            assert r.ids == ids and r.n_tokens == len(ids)
            assert r.decoded_sha256 == hashlib.sha256(b"Hello hello").hexdigest()
        else:
            assert (r.n_tokens, r.ids, r.ids_sha256, r.decoded_sha256) == (0, [], empty, empty)
    assert bpe.tokenize(docs.limit(0)).count() == 0


def one_by_one(raw: bytes, ranks: dict) -> list[int]:
    """Contract the leftmost pair of least rank until none is left."""
    parts = [raw[i:i + 1] for i in range(len(raw))]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return [ranks[p] for p in parts]
        i = min(pairs)[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.randoms(use_true_random=False), st.sampled_from(["ab", "abc", "abcd"]))
def test_long_words_one_by_one(tmp_path, rng, letters):
    """Vocabularies whose ranks don't rise with the parts: contracted tokens have pairs of smaller rank, runs, overlaps."""
    more = {"".join(rng.choice(letters) for _ in range(rng.randint(2, 6))).encode() for _ in range(rng.randint(1, 25))}
    # Every token needs a split into tokens, else no contraction makes it (then it simply never appears).
    order = [bytes([i]) for i in range(256)] + rng.sample(sorted(more), len(more))
    ranks = {t: i for i, t in enumerate(order)}
    path = tmp_path / "v.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for t, i in ranks.items()))
    own = bpe.Coder(str(path), r".+")
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 80))).encode() for _ in range(6)]
    words += [letters[0].encode() * rng.randint(1, 70), letters.encode() * 15]
    assert [np.frombuffer(c, "<u4").tolist() for c in own._long(words)] == [one_by_one(w, ranks) for w in words]


def test_a_megabyte_in_one_word():
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    own, began = bpe.Coder(PATH, PATTERN), time.time()
    coded = own.encode([text])[0]
    assert time.time() - began < 240  # about 35 s on a free core
    assert np.frombuffer(coded, "<u4").tolist() == library().encode_ordinary(text)
    assert own.decode([coded]) == [text.encode()]


def test_op2_over_the_table_agrees_with_the_library(spark):
    sf, lib = "/root/testdata/sf0.001", library()
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = lib.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(),
                     hashlib.sha256((r.text or "").encode()).hexdigest()))
    got = bpe.op2_bpe(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_a_batch_does_not_walk_through_what_is_kept():
    import time

    own = bpe.Coder(*bpe.public_vocabulary())
    text = "some words that are kept, and some more"
    want = own.encode([text])
    own.spaced.update((f"{i} kept", b"") for i in range(800_000))
    start = time.process_time()
    assert all(own.encode([text]) == want for _ in range(200))
    assert time.process_time() - start < 1
