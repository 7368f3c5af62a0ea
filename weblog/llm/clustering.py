"""Centroid clustering by bisector tournaments, in exact integers.

Vectors become integers (``floor(SCALE * x)``). For two centroids a < b the points nearer to b are those with
``x . 2(b - a) > |b|^2 - |a|^2``: the bisector's normal and threshold are integers and are worked out once per round for
every pair. A vector starts with centroid 0 as its champion and meets 1, 2, ...: k - 1 sign tests, each of the champion
against the next one. A sign of zero keeps the champion, which has the smaller number. Only the distance to the last
champion is computed, and exactly.

Each task sums its vectors by cluster and component; the sums of all tasks (k x components rows) come to the driver,
where the next centroids are componentwise ``floor(sum / count)``. The vectors are written once as integers and each
round reads them. Nothing but k centroids and the sums moves between rounds, so a hot cluster costs nothing.

Defined cases: vectors that are null, of another length, or hold a null or non-finite component are left out; an empty cluster keeps its
centroid; with fewer vectors than k there are as many centroids as vectors; start ties (repeated ids) go by the
components; a null vec_id hashes as ``seed:`` and is kept; repeated rows count each; extra columns are ignored; without vectors there are no
rows. Integers beyond +-2^26 are refused with an error, since their squared distance need not fit a long.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weblog.llm.common import pick, table, written

DIM, K, ROUNDS, SCALE, SEED, LARGEST = 64, 8, 10, 1024, 3, 1 << 26


def integers(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id and x (array<int>) of the vectors that are whole."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    whole = (F.size("embedding") == dim) & F.forall(
        x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False)))

    def whole_number(v: Column) -> Column:
        n = F.floor(F.lit(float(scale)) * v)
        return F.when(F.abs(n) <= LARGEST, n.cast("int")).otherwise(
            F.raise_error(F.lit(f"a component beyond {LARGEST}: squared distances may not fit a long")))

    kept = pick(vectors, vec_id="vec_id", embedding="embedding").where(F.coalesce(whole, F.lit(False)))
    return kept.select("vec_id", F.transform(x, whole_number).alias("x"))


def first_centroids(rows: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The k vectors with the smallest sha256 of ``seed:vec_id``, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r.x for r in rows.orderBy(key, "x").limit(k).select("x").collect()], dtype=np.int64)


def bisectors(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normals and thresholds by pair: x is nearer to b than to a if ``x @ normal[a, b] > threshold[a, b]``."""
    norm = (centroids**2).sum(axis=1)
    return 2 * (centroids[None, :] - centroids[:, None]), norm[None, :] - norm[:, None]


def champions(x: np.ndarray, normal: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row by k - 1 sign tests; ties go to the smaller number."""
    best = np.zeros(len(x), dtype=np.int64)
    for b in range(1, len(normal)):
        for a in range(b):
            at = np.flatnonzero(best == a)
            if len(at):
                best[at[x[at] @ normal[a, b] > threshold[a, b]]] = b
    return best


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """A list column whose lists all have ``dim`` integers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def cluster_sums(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """cluster, i (component; -1: the count), total over all vectors."""
    normal, threshold = bisectors(centroids)
    k, dim = centroids.shape

    def run(batches):
        total = np.zeros((k, dim + 1), dtype=np.int64)
        for batch in batches:
            x = matrix(batch.column(0), dim)
            best = champions(x, normal, threshold)
            for c in range(k):
                own = x[best == c]
                total[c, :dim] += own.sum(axis=0)
                total[c, dim] += len(own)
        c, i = np.nonzero(np.ones_like(total))
        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(np.where(i == dim, -1, i)), pa.array(total.ravel())],
                                         ["cluster", "i", "total"])

    return rows.select("x").mapInArrow(run, "cluster long, i long, total long").groupBy("cluster", "i").agg(
        F.sum("total").alias("total"))


def moved(centroids: np.ndarray, sums: DataFrame) -> np.ndarray:
    """The centroids after a round; empty clusters keep theirs."""
    total = {(r.cluster, r.i): r.total for r in sums.collect()}  # k * (components + 1) rows
    out = centroids.copy()
    for c in range(len(out)):
        if n := total.get((c, -1), 0):
            out[c] = [total[c, i] // n for i in range(out.shape[1])]
    return out


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and squared distance of every vector."""
    normal, threshold = bisectors(centroids)

    def run(batches):
        for batch in batches:
            x = matrix(batch.column(1), centroids.shape[1])
            best = champions(x, normal, threshold)
            far = ((x - centroids[best]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(best, pa.int32()), pa.array(far)],
                                             ["vec_id", "cluster", "distance"])

    return rows.select("vec_id", "x").mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE,
            seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """The assignment of every whole vector after ``rounds`` rounds, and the centroids."""
    rows = written(integers(vectors, dim, scale), "cluster-vectors")
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return rows.selectExpr("vec_id", "0 AS cluster", "0L AS distance"), centroids.reshape(0, dim)
    for _ in range(rounds):
        centroids = moved(centroids, cluster_sums(rows, centroids))
    return assigned(rows, centroids), centroids


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = cluster(table(spark, sf_dir, "embeddings"))
    found = written(found, "clusters")
    own = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    digests = [(c, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids.tolist())]
    digests = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    totals = own.join(digests, "cluster").crossJoin(own.agg(F.sum("cluster_inertia").alias("inertia")))
    return found.join(F.broadcast(totals), "cluster").select(  # a row for each of k clusters
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    start = f"""
WITH k AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM}),
v AS MATERIALIZED (SELECT vec_id, unnest(x) AS x, unnest(range({DIM})) AS i FROM k),
s AS (SELECT x, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), x) - 1 AS c FROM k QUALIFY c < {K}),
c0 AS MATERIALIZED (SELECT c, unnest(x) AS x, unnest(range({DIM})) AS i FROM s)"""
    step = """,
d{r} AS (SELECT vec_id, c, sum((v.x - m.x) * (v.x - m.x)) AS d FROM v JOIN c{r} m USING (i) GROUP BY vec_id, c),
a{r} AS MATERIALIZED (SELECT vec_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM d{r} GROUP BY vec_id)"""
    move = """,
c{n} AS MATERIALIZED (
  SELECT m.c, m.i, coalesce(u.x, m.x) AS x FROM c{r} m LEFT JOIN (
    SELECT a.c, i, floor(sum(x) / count(*))::BIGINT AS x FROM a{r} a JOIN v USING (vec_id) GROUP BY a.c, i) u USING (c, i))"""
    out = start + "".join(step.format(r=r) + move.format(r=r, n=r + 1) for r in range(ROUNDS)) + step.format(r=ROUNDS)
    return out + f"""
SELECT vec_id, a.c::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, h.h AS centroid_sha256
FROM a{ROUNDS} a JOIN (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS h FROM c{ROUNDS} GROUP BY c) h USING (c)
"""


ORACLE = _oracle()
