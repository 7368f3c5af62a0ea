"""Near-duplicate groups by SetSketch: banded registers, joint likelihood, full verification.

A document's set holds its distinct n-word shingles. A SetSketch register is the truncated
logarithm, to a base near 1, of the least of exponentially distributed hashes of the
set: registers of a union are the larger ones of each place, and two sets agree in a register with
about their Jaccard similarity.

1. Documents with the same set form a class, by a 128-bit digest; copies collapse map-side.
2. Each band of registers gives a key; classes that share a key are candidates.
3. Rounds of stars: each key picks a pivot and compares it with one member of every other
   component under that key, so a round is linear in the members of all keys. Estimates
   come first: from the numbers of registers that are larger, smaller and equal, the
   likelihood of the similarity is maximised with both set sizes known; pairs that are
   far below the threshold go no further. Links are confirmed on the full sets.
   Confirmed links merge components, and the next round takes other pivots.
4. What stays apart after that is compared in full: all members of a key whose components differ. A
   task holds some members and streams the others past them, so pairs that are no links make
   no rows, and candidates inside a component need no comparison.

A pair at the threshold shares no key with probability (1 - 0.8 ** ROWS) ** BANDS, 4e-7; an
estimate misses its mark by 5 standard deviations as rarely.

Defined cases: documents without words (null or empty text) have an empty set and are linked with
nothing; with fewer than n words the whole sequence is the one shingle; repeated rows belong to one
class; rows without doc_id take part, but a null is never the smallest doc_id of a group that has another.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblog.llm.common import make_room, portions, table, written
from weblog.llm.components import components
from weblog.llm.exact_dedup import located
from weblog.llm.wordhash import mix64, shingle_sets

#: Registers in a band, bands, and the sketch's base, rate and largest register value.
ROWS, BANDS = 4, 28
BASE, RATE, TOP = 1.001, 20.0, 65535
#: Links have intersections of at least PERCENT of the union; estimates below it by MARGIN are dropped.
PERCENT, MARGIN = 80, 0.2
#: Star rounds; members that a task holds, and streams past them, in the last comparison.
ROUNDS, HELD, STREAMED = 2, 1024, 65536
PORTION = 1 << 19

_M = ROWS * BANDS
_RNG = np.random.Generator(np.random.Philox(key=[20, 21]))
_FACTOR = _RNG.integers(0, 2**63, _M, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _RNG.integers(0, 2**63, _M, dtype=np.uint64)


def sketch(sets: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Registers (rows: texts) of the hashed sets that end at ``ends``; an empty set has zeros."""
    counts = np.diff(ends, prepend=0)
    some = counts > 0
    out = np.zeros((len(ends), _M), dtype=np.uint16)
    if some.any():
        starts = (ends - counts)[some]
        for j in range(_M):
            h = sets * _FACTOR[j] + _SHIFT[j]
            h ^= h >> np.uint64(29)
            least = (np.minimum.reduceat(h, starts).astype(np.float64) + 0.5) / 2.0**64
            exponential = -np.log1p(-np.minimum(least, 1 - 2.0**-53)) / RATE
            out[some, j] = np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, TOP)
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One key for each band (columns) and sketch (rows)."""
    bands = registers.astype(np.uint64).reshape(len(registers), BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for j in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, j] + np.uint64(1))
    return key.astype(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity of each pair of sketches, its set sizes known."""
    larger, smaller = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = _M - larger - smaller
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)

    def p(x):
        return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j):
        up, down = p(np.maximum(u - v * j, 0)), p(np.maximum(v - u * j, 0))
        tiny = 1e-12
        return larger * np.log(up + tiny) + smaller * np.log(down + tiny) + equal * np.log(np.maximum(1 - up - down, tiny))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):  # the likelihood is concave: golden-section search
        step = 0.3819660112501051 * (high - low)
        left, right = low + step, high - step
        up = likelihood(left) < likelihood(right)
        low, high = np.where(up, left, low), np.where(up, high, right)
    return (low + high) / 2


def _binary_rows(column: pa.Array, dtype) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=dtype) for x in column.to_pylist()]


def _sets(texts: list, n: int):
    """(start, end, sets, ends) of portions of the texts."""
    for a, b in portions(texts, PORTION):
        yield a, b, *shingle_sets(texts[a:b], n)


def _digests(sets: np.ndarray, ends: np.ndarray) -> list[bytes]:
    starts = np.concatenate([[0], ends[:-1]])
    return [hashlib.blake2b(sets[a:b].tobytes(), digest_size=16).digest() for a, b in zip(starts, ends)]


def sketched(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, id (digest of the set), n (its size), registers, file and row of doc_id, text, file and row."""
    place = docs.columns[2:]

    def run(batches):
        make_room()
        for batch in batches:
            for a, b, sets, ends in _sets(batch.column(1).to_pylist(), n):
                rows = sketch(sets, ends)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).cast(pa.int64()), pa.array(_digests(sets, ends), pa.binary()),
                     pa.array(np.diff(ends, prepend=0), pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary()),
                     *[batch.column(2 + i).slice(a, b - a) for i in range(len(place))]],
                    ["doc_id", "id", "n", "registers", *place])

    return docs.mapInArrow(run, "doc_id long, id binary, n long, registers binary, file string, row long")


def banded(classes: DataFrame) -> DataFrame:
    """id, n, key: a row for each class and band."""
    def run(batches):
        for batch in batches:
            if len(batch):
                registers = np.stack(_binary_rows(batch.column(2), np.uint16))
                at = np.repeat(np.arange(len(batch)), BANDS)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)),
                                                  pa.array(band_keys(registers).ravel())], ["id", "n", "key"])

    return classes.select("id", "n", "registers").mapInArrow(run, "id binary, n long, key long")


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b whose estimate isn't far below the threshold."""
    own = classes.select("id", "n", "registers")
    both = pairs.join(own.toDF("a", "n_a", "r_a"), "a").join(own.toDF("b", "n_b", "r_b"), "b").select(
        "a", "b", "n_a", "n_b", "r_a", "r_b").where(
        f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")

    def run(batches):
        for batch in batches:
            if len(batch):
                n_a, n_b = (np.array(batch.column(i), dtype=float) for i in (2, 3))
                r_a, r_b = (np.stack(_binary_rows(batch.column(i), np.uint16)) for i in (4, 5))
                likely = estimate(r_a, r_b, n_a, n_b) >= percent / 100 - MARGIN
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(likely))

    return both.mapInArrow(run, "a binary, b binary")


def _full_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """id, s: the whole shingle set of every class wanted (id, and the place of one of its documents)."""
    found = docs.select("text", "file", "row").join(wanted, ["file", "row"]).select("id", "text")

    def run(batches):
        for batch in batches:
            for a, b, sets, ends in _sets(batch.column(1).to_pylist(), n):
                starts = np.concatenate([[0], ends[:-1]])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a),
                     pa.array([sets[s:e].tobytes() for s, e in zip(starts, ends)], pa.binary())], ["id", "s"])

    return found.mapInArrow(run, "id binary, s binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    both = pairs.join(sets.toDF("a", "s_a"), "a").join(sets.toDF("b", "s_b"), "b").select("a", "b", "s_a", "s_b")

    def run(batches):
        for batch in batches:
            linked = []
            for x, y in zip(_binary_rows(batch.column(2), np.uint64), _binary_rows(batch.column(3), np.uint64)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(
                pa.array(linked, pa.bool_()))

    return both.mapInArrow(run, "a binary, b binary")


def _across(member: DataFrame, sets: DataFrame, percent: int, doubted: DataFrame | None = None) -> DataFrame:
    """Links a, b between members of different components (``root``) under one key, one for each member and other component.

    Of members in ``doubted`` (a table of ids) all such links.

    Under each key, the members outside its largest component meet all others. They are dealt into
    parts of about ``HELD``, and all members into slices of about ``STREAMED``; a task holds a part, streams a slice
    past it and counts common shingles, so no row is made for a pair that isn't a link. Sets travel as 32-bit hashes, which can
    only add to what is common; links are confirmed on the full sets afterwards (``_settled``).
    """
    def compact(batches):
        for batch in batches:
            short = [(x >> np.uint64(32)).astype(np.uint32).tobytes() for x in _binary_rows(batch.column(1), np.uint64)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(short, pa.binary())], ["id", "t"])

    def run(batches):
        group, held, known = None, [], None
        for batch in batches:
            links = []
            for key, part, side, i, root, t, all_of_it in zip(*[batch.column(k).to_pylist() for k in range(7)]):
                if group != (key, part):
                    group, held, known = (key, part), [], None
                x = np.frombuffer(t, dtype=np.uint32)
                if side == 0:
                    held.append((i, root, x, all_of_it))
                    continue
                if known is None:  # all that is held, as one sorted list of shingles with their owners
                    sizes = np.array([len(h[2]) for h in held])
                    every = np.concatenate([h[2] for h in held])
                    by = np.argsort(every, kind="stable")
                    known = every[by], np.repeat(np.arange(len(held)), sizes)[by], sizes, set()
                every, owner, sizes, done = known
                low, high = np.searchsorted(every, x, side="left"), np.searchsorted(every, x, side="right")
                n = high - low
                at = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                common = np.bincount(owner[at], minlength=len(held))
                for k in np.flatnonzero(100 * common >= percent * (sizes + len(x) - common)):
                    j, other, _, again = held[k]
                    if other != root and (again or (k, root) not in done):
                        done.add((k, root))
                        links.append((min(i, j), max(i, j)))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in links], pa.binary()) for c in (0, 1)], ["a", "b"])

    per_root = member.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    mixed = per_root.groupBy("key").agg(
        F.max(F.struct("c", "root")).alias("most"), F.sum("c").alias("c"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    mixed = mixed.select("key", F.col("most.root").alias("major"),
                         F.ceil((F.col("c") - F.col("most.c")) / HELD).cast("int").alias("parts"),
                         F.ceil(F.col("c") / STREAMED).cast("int").alias("slices"))
    left = member.join(mixed, "key").join(sets.mapInArrow(compact, "id binary, t binary"), "id")
    if doubted is None:
        left = left.withColumn("doubted", F.lit(False))
    else:
        left = left.join(doubted.withColumn("doubted", F.lit(True)), "id", "left").fillna(False, ["doubted"])
    left = written(left.select("key", "id", "root", "t", "doubted", "major", "parts", "slices"), "near-mixed")
    # A part meets every slice of its key: held rows go to all slices, streamed rows to all parts.
    deal = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), n)
    first = left.where("root <> major").withColumn("part", deal(F.col("parts"), 1))
    every = left.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)))
    every = every.join(first.select("key", "part").distinct(), ["key", "part"]).withColumn("slice", deal(F.col("slices"), 2))
    first = first.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices").cast("long") - 1)))
    columns = ["key", F.concat_ws("/", "part", "slice").alias("part"), "id", "root", "t", "doubted"]
    rows = first.select(*columns, F.lit(0).alias("side")).unionByName(every.select(*columns, F.lit(1).alias("side")))
    rows = rows.select("key", "part", "side", "id", "root", "t", "doubted").repartition("key", "part").sortWithinPartitions(
        "key", "part", "side")
    return rows.mapInArrow(run, "a binary, b binary").distinct()


def _settled(keys: DataFrame, sets: DataFrame, links: DataFrame | None, root: DataFrame | None, percent: int):
    """Links and roots after the last comparison.

    It names one link of a member to another component. Where that one isn't confirmed, the member may have
    another: the comparison is repeated and names all links of such members, until none is rejected of any other member.
    """
    doubted: DataFrame | None = None
    while True:
        pairs = written(_across(_members(keys, root), sets, percent, doubted), "near-pairs")
        if pairs.isEmpty():
            return links, root
        new = written(_confirmed(pairs, sets, percent), "near-links")
        if not new.isEmpty():
            links = new if links is None else links.unionByName(new)
            root = written(components(links), "near-roots")
        rejected = pairs.join(new, ["a", "b"], "left_anti")  # stray matches of 32-bit hashes only
        more = rejected.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        more = written(more if doubted is None else more.join(doubted, "id", "left_anti"), "near-doubted")
        if more.isEmpty():
            return links, root
        doubted = more if doubted is None else doubted.unionByName(more)


def _members(keys: DataFrame, root: DataFrame | None) -> DataFrame:
    """The keys with the root of each class's component."""
    if root is None:
        return keys.withColumn("root", F.col("id"))
    return keys.join(root.toDF("id", "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))


def _grouped(given: DataFrame, n: int, percent: int, rounds: int) -> DataFrame:
    """The columns of ``sketched`` but the registers, with root (of the class's component), component_id and n_links."""
    rows = written(sketched(given, n), "near-sketches")
    classes = written(rows.where("n > 0").groupBy("id").agg(
        F.min("doc_id").alias("doc_id"), F.any_value("n").alias("n"), F.any_value("registers").alias("registers"),
        F.min(F.struct("file", "row")).alias("one")), "near-classes")
    keys = banded(classes)
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    keys = written(keys.join(shared, "key").select("id", "n", "key"), "near-keys")

    # The whole sets of all classes that may be compared, fetched once.
    wanted = keys.select("id").distinct().join(classes.select("id", "one.file", "one.row"), "id")
    sets = written(_full_sets(given, wanted, n), "near-sets")

    links, tried, root = None, None, None
    for turn in range(rounds):
        member = _members(keys, root)
        order = F.struct(F.xxhash64("id", "key", F.lit(turn)).alias("h"), "id")
        one = member.groupBy("key", "root").agg(F.min(order).alias("m"))
        pivot = one.groupBy("key").agg(F.min("m").alias("p"), F.count(F.lit(1)).alias("c")).where("c > 1")
        pairs = one.join(pivot, "key").select(F.col("m.id").alias("x"), F.col("p.id").alias("y")).where("x <> y")
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = written(_likely(pairs, classes, percent), "near-pairs")
        if pairs.isEmpty():
            continue
        new = written(_confirmed(pairs, sets, percent), "near-links")
        tried = pairs if tried is None else tried.unionByName(pairs)
        links = new if links is None else links.unionByName(new)
        if not new.isEmpty():
            root = written(components(links), "near-roots")
    links, root = _settled(keys, sets, links, root, percent)

    if links is None or root is None:
        classes = classes.select("id", F.col("id").alias("root"), F.col("doc_id").alias("component_id"),
                                 F.lit(0).cast("long").alias("n_links"))
    else:
        ends = links.select(F.col("a").alias("id")).union(links.select("b")).groupBy("id").agg(
            F.count(F.lit(1)).alias("n_links"))
        own = classes.select("id", "doc_id").join(root.toDF("id", "root"), "id", "left").withColumn(
            "root", F.coalesce("root", "id"))
        least = own.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        classes = own.join(least, "root").join(ends, "id", "left").select(
            "id", "root", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return rows.drop("registers").withColumn("id", F.when(F.col("n") > 0, F.col("id"))).join(classes, "id", "left")


def groups(docs: DataFrame, n: int = 5, percent: int = PERCENT, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, class_id, n_links.

    ``class_id`` is the class of equal sets, in hexadecimal (null without words), and ``n_links`` the
    confirmed links of the class to other classes that were needed to connect its group.
    """
    out = _grouped(located(docs).select("doc_id", "text", "file", "row"), n, percent, rounds)
    out = out.withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id",
                      F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
                      F.lower(F.hex("id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def unique(docs: DataFrame, n: int = 5, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay: of each group one, with the smallest doc_id (a null comes last), then the first in place.

    Rows without words are in no group, and stay.
    """
    rows = located(docs)
    found = written(_grouped(rows.select("doc_id", "text", "file", "row"), n, percent, ROUNDS), "near-rows")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row")
    kept = found.where("n > 0").groupBy("root").agg(F.min(order).alias("best")).select("best.file", "best.row")
    kept = kept.unionByName(found.where("n = 0").select("file", "row"))
    plain = [f"c{i}" for i in range(len(docs.columns))]
    return rows.join(kept, ["file", "row"], "left_semi").select(*plain).toDF(*docs.columns)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"), n=2).select("doc_id", "n_shingles", "component_id", "kept")


#: Exact, by an inverted index of shingles; components by walking the links.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN ws
      ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END)) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common_
      FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
      WHERE 100 * common_ >= 80 * (x.n + y.n - common_)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS low FROM documents
      UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.a WHERE r.low < e.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.low) AS component_id, d.doc_id = min(r.low) AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id GROUP BY d.doc_id, n.n
"""
