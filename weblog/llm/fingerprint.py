"""Document fingerprints: MinHash by universal hashing, banded links with verified Jaccard.

A document's shingles are its distinct runs of five words (fewer words: the whole sequence). Each
of ``PERMUTATIONS`` universal hash functions ``a * x + b`` modulo the Mersenne prime 2 ** 31 - 1 is minimised
over the set; the signature holds the low 16 bits of every minimum. The share of equal entries, corrected for chance,
estimates the Jaccard similarity. ``links`` joins documents that share a signature band and verifies the
similarity on the full sets.

``with_next`` gives each row the text that follows it in falling doc_id order without a global
sort: ids are cut at quantiles into stretches, each stretch is sorted, and the first row of each stretch
also closes the one before. Rows of equal id are ordered by their text; null ids come last.

Defined cases: a null text counts as empty; the signature of an empty set is that of no
shingle, equal to itself and unlike any other; a single document is its own next; an empty table gives
no rows; repeated rows follow one another.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblog.llm.common import pick, portions, table, written
from weblog.llm.wordhash import mix64, shingle_sets

SHINGLE, PERMUTATIONS, BANDS = 5, 64, 16
STRETCHES, PORTION = 256, 1 << 21
_P = np.uint64(2**31 - 1)
_RNG = np.random.Generator(np.random.Philox(key=[8, 31]))
_A = _RNG.integers(1, 2**31 - 1, PERMUTATIONS, dtype=np.uint64)
_B = _RNG.integers(0, 2**31 - 1, PERMUTATIONS, dtype=np.uint64)


def signatures(sets: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Minima of all permutations (columns) over every hashed set (rows); an empty set has zeros."""
    counts = np.diff(ends, prepend=0)
    some = counts > 0
    out = np.zeros((len(ends), PERMUTATIONS), dtype=np.uint16)
    if some.any():
        starts = (ends - counts)[some]
        x = sets >> np.uint64(33)  # 31 bits: a product of two such numbers fits
        for j in range(PERMUTATIONS):
            h = x * _A[j] + _B[j]
            h = (h & _P) + (h >> np.uint64(31))
            h = (h & _P) + (h >> np.uint64(31))
            out[some, j] = mix64(np.minimum.reduceat(h, starts)) & np.uint64(0xFFFF)
    return out


def fingerprints(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Signatures, and the sizes of the sets."""
    out = [np.zeros((0, PERMUTATIONS), dtype=np.uint16)]
    sizes = [np.zeros(0, dtype=np.int64)]
    for a, b in portions(texts, PORTION):
        sets, ends = shingle_sets(texts[a:b], SHINGLE)
        out.append(signatures(sets, ends))
        sizes.append(np.diff(ends, prepend=0))
    return np.concatenate(out), np.concatenate(sizes)


def likeness(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity, row by row; 1 for two empty sets, 0 for one."""
    same = (a == b).mean(axis=1)
    chance = 2.0**-16
    near = np.clip((same - chance) / (1 - chance), 0, 1)
    return np.where((n_a == 0) | (n_b == 0), ((n_a == 0) & (n_b == 0)).astype(float), near)


def text_form(signature: np.ndarray, size: int) -> str:
    """A fingerprint as a string: hexadecimal signature, or ``empty``."""
    return signature.astype(">u2").tobytes().hex() if size else "empty"


def with_next(docs: DataFrame, stretches: int = STRETCHES) -> DataFrame:
    """doc_id, text, stretch and closing: the rows of a stretch, in falling order and with its
    closing row last, are consecutive documents. ``closing`` marks the copy of the row that begins the next stretch.
    """
    d = pick(docs, doc_id="doc_id", text="text").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    shares = [i / stretches for i in range(1, stretches)]
    found = d.agg(F.percentile_approx("doc_id", shares, 10 * stretches)).first()[0] or []
    cuts = F.array(*[F.lit(int(c)) for c in sorted(set(found))]).cast("array<bigint>")
    # Stretch 0 holds the largest ids; nulls come after all.
    d = d.withColumn("stretch", F.when(F.col("doc_id").isNull(), stretches).otherwise(
        F.size(F.filter(cuts, lambda c: c > F.col("doc_id")))))
    tops = {r.stretch: r.top for r in d.groupBy("stretch").agg(F.max("doc_id").alias("top")).collect()}
    order = sorted(tops)  # at most ``stretches`` + 1
    if not order:
        return d.withColumn("closing", F.lit(False))
    ids = [t for t in tops.values() if t is not None]
    heads = d.where(F.col("doc_id").isin(ids) | F.col("doc_id").isNull()).groupBy("stretch").agg(
        F.max("doc_id").alias("doc_id"), F.min("text").alias("text"))
    before = dict(zip(order, [order[-1], *order[:-1]]))
    moved = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("stretch"))
    closing = heads.select("doc_id", "text", moved.alias("stretch"), F.lit(True).alias("closing"))
    return d.withColumn("closing", F.lit(False)).unionByName(closing)


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by the first as many code points of ``following``."""
    k = len(text) // 3
    return text[:len(text) - k] + following[:k]


def compared(docs: DataFrame, stretches: int | None = None) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likenesses.

    More stretches than ``STRETCHES`` are made where the session shuffles wider, up to 16 times as many.
    """
    if stretches is None:
        wide = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        stretches = min(max(STRETCHES, wide), 16 * STRETCHES)
    rows = with_next(docs, stretches)
    # Null ids last, equal ids by text, and the closing row after all.
    rows = rows.repartition("stretch").sortWithinPartitions(
        "stretch", "closing", F.col("doc_id").desc_nulls_last(), "text")

    def run(batches):
        last = None  # the row before: stretch, doc_id, text

        def out(given):
            own = [g[1] for g in given]
            new = [edited(g[1], g[2]) for g in given]
            a, n_a = fingerprints(own)
            b, n_b = fingerprints(new)
            c, n_c = fingerprints([g[2] for g in given])
            near_b, near_c = likeness(a, n_a, b, n_b), likeness(a, n_a, c, n_c)
            return pa.RecordBatch.from_arrays([
                pa.array([g[0] for g in given], pa.int64()), pa.array([len(t) for t in own], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new]),
                pa.array([text_form(s, k) for s, k in zip(a, n_a)]), pa.array([text_form(s, k) for s, k in zip(b, n_b)]),
                pa.array(near_b, pa.float64()), pa.array(near_c, pa.float64())], names)

        for batch in batches:
            given, size = [], 0
            for doc_id, text, stretch, closing in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if last is not None and last[0] == stretch:
                    given.append((last[1], last[2], text))
                    size += len(last[2])
                last = None if closing else (stretch, doc_id, text)
                if size > PORTION:
                    yield out(given)
                    given, size = [], 0
            if given:
                yield out(given)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return rows.select("doc_id", "text", "stretch", "closing").mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double")


def links(docs: DataFrame, least: float = 0.8, bands: int = BANDS) -> DataFrame:
    """Verified links between different sets: a, b (digests of the sets), jaccard; and membership by ``sets``.

    Documents with the same set are one class. Classes meet in a signature band, and the pair's Jaccard
    similarity is taken on the full sets.
    """
    classes = sets(docs).groupBy("class_id").agg(F.any_value("s").alias("s"), F.any_value("keys").alias("keys"))
    classes = written(classes, "fingerprint-classes")
    bucket = classes.select("class_id", F.posexplode("keys").alias("band", "key"))
    pairs = bucket.alias("x").join(bucket.alias("y"), ["band", "key"]).where("x.class_id < y.class_id").select(
        F.col("x.class_id").alias("a"), F.col("y.class_id").alias("b")).distinct()
    own = classes.select("class_id", "s")
    both = pairs.join(own.toDF("a", "s_a"), "a").join(own.toDF("b", "s_b"), "b").select(
        "a", "b", F.size(F.array_intersect("s_a", "s_b")).alias("common"), (F.size("s_a") + F.size("s_b")).alias("total"))
    return both.withColumn("jaccard", F.col("common") / (F.col("total") - F.col("common"))).where(
        F.col("jaccard") >= least).select("a", "b", "jaccard")


def sets(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, s (the hashed shingles), keys (of the signature bands); documents without words are left out."""
    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            s, ends = shingle_sets(texts, SHINGLE)
            starts = np.concatenate([[0], ends[:-1]])
            bands = signatures(s, ends).reshape(len(texts), BANDS, -1)
            rows = [(d, hashlib.blake2b(s[a:b].tobytes(), digest_size=16).hexdigest(), s[a:b].view(np.int64),
                     [int.from_bytes(hashlib.blake2b(k.tobytes(), digest_size=8).digest(), "little", signed=True) for k in g])
                    for d, a, b, g in zip(batch.column(0).to_pylist(), starts, ends, bands) if b > a]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()),
                 pa.array([r[2] for r in rows], pa.list_(pa.int64())), pa.array([r[3] for r in rows], pa.list_(pa.int64()))],
                ["doc_id", "class_id", "s", "keys"])

    return pick(docs, doc_id="doc_id", text="text").mapInArrow(
        run, "doc_id long, class_id string, s array<long>, keys array<long>")


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(table(spark, sf_dir, "documents"))
