"""Quality classifier: random Fourier features, ridge by normal equations, isotonic calibration.

Each text is described by document statistics. Random Fourier features of the scaled statistics
approximate a Gaussian kernel; each partition sums its part of the normal equations,
and their total gives the ridge weights. Raw scores of other labelled rows are binned and
calibrated by pooling adjacent violators. Labels are joined to the slim
statistics, which are taken in one pass over the texts and written down.

Labelled rows whose crc32(doc_id as text) mod 4 is 2 are held out of all learning; 0 and 1 fit
the ridge, 3 the calibration. All labelled rows count: each partition sends only its sums.

The model (scales, frequencies, weights, calibration) has a fixed size and goes to the tasks with
the function; scoring is a pass without a shuffle.

Defined cases: a null text counts as empty, and empty texts are scored like others; null labels and
labels without a document are ignored, and a document with several labels counts with each; without
any usable label every score is 1, so a filter keeps all; equal texts have equal scores.
"""
from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weblog.llm.common import make_room, pick, portions, table, written
from weblog.llm.wordhash import IS_WHITE, joined, word_hashes

#: Random features, kernel width, ridge penalty, calibration bins, least score kept.
FEATURES, WIDTH, PENALTY, BINS, KEEP = 256, 4.0, 1e-3, 200, 0.7
#: Code points described at once: arrays of this size stay in the processor's cache.
PORTION = 1 << 19

NAMES = ["length", "words", "word_length", "word_spread", "upper", "lower", "digit", "punctuation", "symbol", "not_ascii",
         "control", "white", "lines", "line_length", "distinct_words", "repeated_next", "repeated_pairs", "top_word",
         "distinct_lines", "stops_ended", "bar_words", "upper_words"]


def _class(pattern: str) -> np.ndarray:
    return np.array([bool(re.match(pattern, chr(i))) for i in range(128)] + [False] * 128)


_CLASSES = [_class("[A-Z]"), _class("[a-z]"), _class("[0-9]"), _class("[.,;:?'\"()-]"), _class("[^A-Za-z0-9\\s.,;:?'\"()\\x00-\\x1f\\x7f-]"),
            np.arange(256) >= 128, (np.arange(256) < 32) & ~IS_WHITE, IS_WHITE]


def _per(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the stretches that end at ``ends``."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return np.diff(total[ends], prepend=0)


def _distinct(values: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of every owner, and the count of its most frequent one."""
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    new = np.ones(len(v), dtype=bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(at, append=len(v))
    top = np.zeros(n)
    np.maximum.at(top, o[at], runs)
    return np.bincount(o[at], minlength=n).astype(float), top


def statistics(texts: list[str | None]) -> np.ndarray:
    """One row of statistics per text, in the order of ``NAMES``; all but the sizes are shares."""
    raw, ends = joined(texts)
    n = len(texts)
    size = np.diff(ends, prepend=0) - 1.0
    some = np.maximum(size, 1)
    shares = [_per(c[raw], ends) for c in _CLASSES]
    shares[-1] = shares[-1] - 1  # the byte after each text
    hashes, word_ends = word_hashes(raw, ends)
    count = np.diff(word_ends, prepend=0).astype(float)
    words = np.maximum(count, 1)
    owner = np.repeat(np.arange(n), count.astype(int))
    white = IS_WHITE[raw]
    edge = np.flatnonzero(white[1:] != white[:-1]) + 1
    edge = edge if not len(raw) or white[0] else np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    length = (end - start).astype(float)
    mean = _per(length, word_ends) / words
    spread = np.sqrt(np.maximum(_per(length**2, word_ends) / words - mean**2, 0))
    distinct, top = _distinct(hashes, owner, n)
    same = np.zeros(len(hashes))
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    pairs = np.zeros(len(hashes), dtype=np.uint64)
    pairs[:-1] = hashes[:-1] * np.uint64(3) + hashes[1:]
    distinct_pairs, _ = _distinct(pairs, owner, n)
    last = raw[end - 1] if len(end) else raw[:0]
    first = raw[start] if len(start) else raw[:0]
    ended = np.isin(last, [46, 33, 63])
    bar = (length == 1) & (first == 124)
    upper = _CLASSES[0][first] & (_CLASSES[0][raw[np.minimum(start + 1, len(raw) - 1)]] if len(start) else first > 0)
    feed = np.flatnonzero(raw == 10)
    line_owner = np.searchsorted(ends, feed, side="right")
    lines = np.bincount(line_owner, minlength=n) + 1.0
    # A line's key is the sum of its words' hashes.
    line = np.searchsorted(feed, start)
    new = np.ones(len(start), dtype=bool)
    new[1:] = (line[1:] != line[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    full_lines = np.bincount(owner[at], minlength=n)
    line_distinct = np.zeros(n)
    if len(at):
        line_distinct, _ = _distinct(np.add.reduceat(hashes, at), owner[at], n)
    return np.column_stack([
        np.log1p(size), np.log1p(count), mean, spread, *[s / some for s in shares], np.log1p(lines),
        np.log1p(size / lines), distinct / words, _per(same, word_ends) / words, 1 - distinct_pairs / words, top / words,
        line_distinct / np.maximum(full_lines, 1), _per(ended, word_ends) / words, _per(bar, word_ends) / words,
        _per(upper, word_ends) / words])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps: np.ndarray  # raw scores at which the calibrated score is known
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.frequencies + self.phases
        return np.column_stack([np.cos(z) * np.sqrt(2 / len(self.phases)), np.ones(len(x))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.steps, self.levels)


def fold(doc_id: Column) -> Column:
    """crc32 of the doc_id as text, mod 4 (null: as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4))


def pool(total: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Isotonic means: pool adjacent violators over bins in rising order."""
    out: list[list[float]] = []
    for t, o in zip(total, ones):
        out.append([t, o, 1])
        while len(out) > 1 and out[-2][1] * out[-1][0] >= out[-1][1] * out[-2][0]:
            t, o, k = out.pop()
            out[-1] = [out[-1][0] + t, out[-1][1] + o, out[-1][2] + k]
    return np.concatenate([np.full(int(k), o / t) for t, o, k in out]) if out else np.zeros(0)


def described(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each document."""
    def run(batches):
        make_room()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in portions(texts, PORTION):
                rows = statistics(texts[a:b])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).cast(pa.int64()),
                     pa.FixedSizeListArray.from_arrays(rows.ravel(), rows.shape[1]).cast(pa.list_(pa.float64()))],
                    ["doc_id", "x"])

    return pick(docs, doc_id="doc_id", text="text").mapInArrow(run, "doc_id long, x array<double>")


def described_rows(docs: DataFrame, text: str = "text", name: str = "x_") -> DataFrame:
    """``docs`` with one more column, the statistics of its text; all rows and columns stay."""
    at = docs.columns.index(text)

    def run(batches):
        make_room()
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for a, b in portions(texts, PORTION):
                rows = statistics(texts[a:b])
                x = pa.FixedSizeListArray.from_arrays(rows.ravel(), rows.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, x], schema.names)

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])
    return docs.mapInArrow(run, schema)


def fit(stats: DataFrame, labels: DataFrame, seed: int = 10) -> Model | None:
    """Learn from the labelled rows that are not held out; None without such rows.

    ``stats`` is what ``described`` gives.
    """
    own = pick(labels, doc_id="doc_id", y="quality").where("doc_id IS NOT NULL AND y IN (0, 1)")
    own = own.withColumn("fold", fold(F.col("doc_id"))).where("fold <> 2")
    rows = written(stats.join(own, "doc_id"), "quality-labelled")
    learn, adjust = rows.where("fold <> 3"), rows.where("fold = 3")
    if learn.isEmpty():
        return None
    k = len(NAMES)
    stats = learn.agg(*[f(F.col("x")[i]).alias(f"{n}{i}") for i in range(k) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = np.array([stats[f"m{i}"] for i in range(k)])
    scale = np.array([stats[f"s{i}"] or 0.0 for i in range(k)])
    rng = np.random.Generator(np.random.Philox(key=[seed, 1]))
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), rng.normal(size=(k, FEATURES)) / WIDTH,
                  rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), np.zeros(1), np.ones(1))

    def sums(batches):
        a = np.zeros((FEATURES + 1, FEATURES + 1))
        b, n = np.zeros(FEATURES + 1), 0
        for batch in batches:
            z = model.features(np.array(batch.column("x").to_pylist()).reshape(-1, k))
            a += z.T @ z
            b += z.T @ np.array(batch.column("y").to_pylist(), dtype=float)
            n += len(z)
        upper = a[np.triu_indices(FEATURES + 1)]
        values = np.concatenate([upper, b, [n]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["i", "v"])

    parts = learn.select("x", "y").mapInArrow(sums, "i long, v double").groupBy("i").agg(F.sum("v").alias("v"))
    total = np.zeros((FEATURES + 1) * (FEATURES + 2) // 2 + FEATURES + 2)
    for i, v in parts.collect():  # as many rows as the normal equations have numbers
        total[i] = v
    n = total[-1]
    gram = np.zeros((FEATURES + 1, FEATURES + 1))
    at = np.triu_indices(FEATURES + 1)
    gram[at] = total[:len(at[0])]
    gram = gram + gram.T - np.diag(np.diag(gram))
    penalty = PENALTY * n * np.eye(FEATURES + 1) / FEATURES
    penalty[-1, -1] = 1e-9 * n
    model.weights = np.linalg.solve(gram + penalty, total[len(at[0]):-1])
    return calibrate(model, adjust if not adjust.isEmpty() else learn)


def calibrate(model: Model, rows: DataFrame) -> Model:
    """Bin the raw scores of labelled rows and pool the bins' shares of label 1."""
    k = len(NAMES)

    def binned(batches):
        total, ones = np.zeros(BINS), np.zeros(BINS)
        for batch in batches:
            raw = model.raw(np.array(batch.column("x").to_pylist()).reshape(-1, k))
            at = np.clip(((raw + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
            total += np.bincount(at, minlength=BINS)
            ones += np.bincount(at, weights=np.array(batch.column("y").to_pylist(), dtype=float), minlength=BINS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS)), pa.array(total), pa.array(ones)], ["i", "n", "ones"])

    got = rows.select("x", "y").mapInArrow(binned, "i long, n double, ones double").groupBy("i").agg(
        F.sum("n").alias("n"), F.sum("ones").alias("ones")).where("n > 0").orderBy("i").collect()
    at = np.array([r.i for r in got])
    model.steps = (at + 0.5) * 2 / BINS - 0.5
    model.levels = np.clip(pool(np.array([r.n for r in got]), np.array([r.ones for r in got])), 0, 1)
    return model


def _scorer(model: Model | None, of, at: int, names: list[str]):
    def run(batches):
        for batch in batches:
            values = batch.column(at).to_pylist()
            done = np.ones(len(values)) if model is None else of(values)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(done, pa.float64())], names)

    return run


def score_statistics(stats: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score of each row that ``described`` gives."""
    run = _scorer(model, lambda xs: model.score(np.array(xs, dtype=float).reshape(-1, len(NAMES))), 1,
                  ["doc_id", "x", "score"])
    return stats.mapInArrow(run, "doc_id long, x array<double>, score double").drop("x")


def scored_rows(rows: DataFrame, model: Model | None, statistics: str = "x_", score: str = "score_") -> DataFrame:
    """``rows`` (of ``described_rows``) with one more column, the score; the texts aren't described again."""
    of = lambda xs: model.score(np.array(xs, dtype=float).reshape(-1, len(NAMES)))
    schema = T.StructType([*rows.schema.fields, T.StructField(score, T.DoubleType())])
    return rows.mapInArrow(_scorer(model, of, rows.columns.index(statistics), schema.names), schema)


def scored(docs: DataFrame, model: Model | None, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with one more column, the score of its text; all rows and columns stay."""
    def of(texts):
        done = np.ones(len(texts))
        for a, b in portions(texts, PORTION):
            done[a:b] = model.score(statistics(texts[a:b]))
        return done

    schema = T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())])
    return docs.mapInArrow(_scorer(model, of, docs.columns.index(text), schema.names), schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = written(described(table(spark, sf_dir, "documents")), "quality-statistics")
    done = score_statistics(stats, fit(stats, table(spark, sf_dir, "labels")))
    return done.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "score",
                       (F.col("score") >= KEEP).cast("int").alias("predicted"))
