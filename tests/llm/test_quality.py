import numpy as np
from pyspark.sql import Row

from weblog.llm import quality as q

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in q.op10_quality(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert len(rows) == docs and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows.values())
    import zlib
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows.values())
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    held = [(rows[x.doc_id].predicted, x.quality) for x in labels if rows[x.doc_id].held_out]
    assert len(held) > 50 and np.mean([p == y for p, y in held]) >= 0.95


def test_equal_texts_equal_scores_in_any_batch(spark):
    texts = ["Some plain words here.", None, "", "X!! Y!!", "a " * 100000, "\x00", "ä | b | c"]
    one = np.concatenate([q.statistics([t]) for t in texts])
    assert np.isfinite(one).all() and np.allclose(q.statistics(texts), one) and q.statistics([]).shape == (0, len(q.NAMES))


def test_statistics_of_a_text():
    row = dict(zip(q.NAMES, q.statistics(["Ab cd. Ab\nAb | XY"])[0]))
    assert np.isclose(np.exp(row["words"]) - 1, 6) and np.isclose(row["distinct_words"], 4 / 6)
    assert np.isclose(row["bar_words"], 1 / 6) and np.isclose(row["upper_words"], 1 / 6) and np.isclose(row["stops_ended"], 1 / 6)
    assert np.isclose(row["repeated_next"], 1 / 6) and np.isclose(np.exp(row["lines"]) - 1, 2)


def test_pooling_is_isotonic():
    rng = np.random.default_rng(3)
    for _ in range(50):
        total = rng.integers(1, 9, 12).astype(float)
        ones = np.minimum(total, rng.integers(0, 9, 12))
        level = q.pool(total, ones)
        assert (np.diff(level) >= -1e-12).all() and np.isclose((level * total).sum(), ones.sum())
    assert q.pool(np.array([1.0, 1.0]), np.array([1.0, 0.0])).tolist() == [0.5, 0.5]


def test_without_labels_and_odd_rows(spark):
    docs = spark.createDataFrame([Row(doc_id=1, text=None, score="x"), Row(doc_id=None, text="a b", score="y")],
                                 "doc_id long, text string, score string")
    none = spark.createDataFrame([(1, None), (None, 1), (9, 1)], "doc_id long, quality int")
    stats = q.described(docs)
    assert q.fit(stats, none) is None
    assert [r.score_ for r in q.scored(docs, None, score="score_").collect()] == [1.0, 1.0]
    some = spark.createDataFrame([(1, 1), (1, 1)], "doc_id long, quality int")
    model = q.fit(stats, some)
    assert model is None or all(0 <= r.score_ <= 1 for r in q.scored(docs, model, score="score_").collect())
    assert q.score_statistics(q.described(docs.limit(0)), model).count() == 0


def test_against_a_central_solution(spark):
    """The same statistics, solved in one place with numpy: ridge on all rows at once, isotonic by brute force."""
    stats = q.described(spark.read.parquet(f"{SF}/documents.parquet"))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = q.fit(stats, labels)
    x = {r.doc_id: np.array(r.x) for r in stats.collect()}
    import zlib
    rows = [(r.doc_id, r.quality, zlib.crc32(str(r.doc_id).encode()) % 4) for r in labels.collect() if r.quality in (0, 1) and r.doc_id in x]
    learn = np.array([x[i] for i, _, f in rows if f in (0, 1)])
    y = np.array([v for _, v, f in rows if f in (0, 1)], dtype=float)
    assert np.allclose(model.mean, learn.mean(axis=0)) and np.allclose(model.scale, np.where(learn.std(axis=0) > 1e-9, learn.std(axis=0), 1))
    z = model.features(learn)
    penalty = np.diag([q.PENALTY * len(y) / q.FEATURES] * q.FEATURES + [1e-9 * len(y)])
    weights = np.linalg.solve(z.T @ z + penalty, z.T @ y)
    assert np.abs(z @ weights - z @ model.weights).max() < 1e-6
    # Calibration: the best rising step function over the bins of the adjusting fold, as min-max of averages.
    held = [(model.raw(x[i][None])[0], v) for i, v, f in rows if f == 3]
    at = np.clip(((np.array([h[0] for h in held]) + 0.5) / 2 * q.BINS).astype(int), 0, q.BINS - 1)
    bins = sorted(set(at))
    n = np.array([(at == b).sum() for b in bins], dtype=float)
    ones = np.array([sum(v for a, (_, v) in zip(at, held) if a == b) for b in bins], dtype=float)
    k = len(bins)
    best = [max(min(ones[i:j + 1].sum() / n[i:j + 1].sum() for j in range(m, k)) for i in range(m + 1)) for m in range(k)]
    assert np.allclose(model.steps, (np.array(bins) + 0.5) * 2 / q.BINS - 0.5) and np.allclose(model.levels, best)
    scores = {r.doc_id: r.score for r in q.op10_quality(spark, SF).collect()}
    want = {i: float(np.interp(model.raw(v[None])[0], model.steps, model.levels)) for i, v in x.items()}
    assert max(abs(scores[i] - want[i]) for i in want) < 1e-6
