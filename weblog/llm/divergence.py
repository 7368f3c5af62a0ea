"""Source divergence audit by count-level bitmaps.

How far the term shares of a (lang, source) group lie from those of the other sources of its language, and which
terms it overuses against the whole language.

1. One pass over the texts counts terms per (lang, source, term), and per term the documents; both are summed
   map-side, first in each task's dictionary. Every group that occurs leaves a row, also without terms.
2. The terms in at least ``LEAST`` documents of a language are kept. They are dealt by hash to blocks and numbered
   there, by falling count, so that the 64 terms of a word have few different counts.
3. For each (group, count) the terms with that count are bits: one 64-bit word for each word that isn't empty.
4. A task takes a block. AND and popcount of two groups' words give the joint cells (how many terms have count c
   in one and c' in the other); cells with a zero follow by complement from the popcounts. A cell's size times
   ``f`` of its two counts is summed over the cells of a pair, then over blocks.

Everything is integers: shares are whole multiples of 1e-9, found by long division (counts below 9e15).
Blocks hold fewer terms where a language has more sources, so a block stays near ``BLOCK_ROWS`` rows down to 64 terms.
A hot source or language is split by blocks, since no step groups by source or language alone but for the sums of
already counted terms and the ranks, which are limited to ten rows a task before they meet.

Defined cases: null text, lang and source count as empty; repeated rows count as documents of their own; a language
without kept terms gives its pairs the value 0 and no terms; a lone source has no pair; ties rank by the item's UTF-8
bytes; very long texts are counted in pieces cut between terms; extra columns are ignored; no rows give no rows.
"""
from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weblog.llm.common import pick, table, written

#: Least documents of a kept term; scale of shares; ranks of terms.
LEAST, SCALE, TOP = 10, 10**9, 10
#: Terms a counting task holds before it hands them on; bytes counted at once; bitmap rows a block aims at; cells at once.
HELD, PIECE, BLOCK_ROWS, CELLS = 300_000, 1 << 20, 1 << 16, 1 << 21
_TERM = re.compile(rb"[a-z\x80-\xff]+")  # of lower-cased UTF-8
_OTHER = re.compile(rb"[^a-z\x80-\xff]")


def pieces(raw: bytes, size: int = PIECE):
    """``raw`` cut between terms into pieces of about ``size`` bytes."""
    start = 0
    while len(raw) - start > size:
        cut = _OTHER.search(raw, start + size)
        if not cut:
            break
        yield raw[start:cut.start()]
        start = cut.start()
    yield raw[start:] if start else raw


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents): partial sums of each task.

    Every (lang, source) that occurs has a row with a null term.
    """
    def flush(counts: dict, documents: dict):
        rows = [(*g, t, n, documents[g][t]) for g, c in counts.items() for t, n in c.items()]
        rows += [(*g, None, 0, 0) for g in counts]
        counts.clear()
        documents.clear()
        lang, source, term, n, d = zip(*rows) if rows else ((),) * 5
        return pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()).cast(pa.string()),
             pa.array(n, pa.int64()), pa.array(d, pa.int64())], ["lang", "source", "term", "n", "docs"])

    def run(batches):
        counts: dict[tuple[str, str], Counter] = {}
        documents: dict[tuple[str, str], Counter] = {}
        held = 0
        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, text in enumerate(batch.column(2)):
                g = (langs[i] or "", sources[i] or "")
                if g not in counts:
                    counts[g], documents[g] = Counter(), Counter()
                c, before = counts[g], len(counts[g])
                raw = (text.as_buffer().to_pybytes() if text.is_valid else b"").lower()
                if len(raw) <= PIECE:
                    found = _TERM.findall(raw)
                    c.update(found)
                    documents[g].update(set(found))
                else:
                    own: set[bytes] = set()
                    for piece in pieces(raw):
                        found = _TERM.findall(piece)
                        c.update(found)
                        own.update(found)
                    documents[g].update(own)
                held += len(c) - before
                if held > HELD:
                    yield flush(counts, documents)
                    held = 0
        yield flush(counts, documents)

    return pick(docs, lang="lang", source="source", text="text").mapInArrow(
        run, "lang string, source string, term string, n long, docs long")


def share(count, total, terms):
    """1 + floor(1e9 * (count + 2) / (total + 2 * terms)) by long division in steps of 1000 (numpy int64)."""
    d = total + 2 * terms
    rest, out = count + 2, 0
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // d, rest % d
    return out + 1


def share_column(count: Column, total: Column, terms: Column) -> Column:
    """``share`` as a column."""
    d = total + F.lit(2) * terms
    rest, out = count + F.lit(2), F.lit(0).cast("long")
    for _ in range(3):
        rest = rest * F.lit(1000)
        out, rest = out * F.lit(1000) + F.call_function("div", rest, d), rest % d
    return out + F.lit(1)


def distance(p, q):
    """floor((p - q)^2 / (p + q)) (numpy int64)."""
    return (p - q) ** 2 // (p + q)


def joint_values(source: np.ndarray, count: np.ndarray, word: np.ndarray, bits: np.ndarray, totals: np.ndarray,
                 terms: int, kept: int) -> np.ndarray:
    """Matrix of f summed over one block's terms for every pair of groups.

    The first four arrays are the block's bitmap (group number, count above 0, word, bits); ``totals`` has each
    group's sum of counts; ``terms`` is the number of terms in the block, ``kept`` (V) in the language.
    """
    n = len(totals)
    order = np.lexsort((count, source, word))
    source, count, word, bits = source[order], count[order], word[order], bits[order]
    zero = share(np.zeros(n, dtype=np.int64), totals, kept)
    p = share(count, totals[source], kept)
    size = np.bitwise_count(bits).astype(np.int64)
    both_zero = distance(zero[:, None], zero[None, :])
    # As if every term of group a were absent from group b: its own counts against b's share of none.
    alone = np.zeros((n, n), dtype=np.int64)
    step = max(1, CELLS // max(n, 1))
    for a in range(0, len(p), step):
        s = slice(a, a + step)
        np.add.at(alone, source[s], size[s, None] * distance(p[s, None], zero[None, :]))
    present = np.zeros(n, dtype=np.int64)
    np.add.at(present, source, size)
    out = alone + alone.T + (terms - present[:, None] - present[None, :]) * both_zero
    # Joint cells: what lies in both was counted as absent from each.
    edges = np.flatnonzero(np.diff(word, prepend=-1)) if len(word) else word
    for a, b in zip(edges, np.append(edges[1:], len(word))):
        step = max(1, CELLS // (b - a))
        for c in range(a, b, step):
            rows = slice(c, min(c + step, b))
            cells = np.bitwise_count(bits[rows, None] & bits[None, a:b])
            i, j = np.nonzero(cells)
            size_ = cells[i, j].astype(np.int64)
            i, j = i + c, j + a
            g, h = source[i], source[j]
            value = distance(p[i], p[j]) - distance(p[i], zero[h]) - distance(zero[g], p[j]) + both_zero[g, h]
            np.add.at(out, (g, h), size_ * value)
    return out


def _pairs(key: tuple, rows: pa.Table) -> pa.Table:
    """lang, source, item, value of one block. Rows with count 0 name the groups of the language."""
    named = pa.compute.equal(rows["count"], 0)
    groups, cells = rows.filter(named), rows.filter(pa.compute.invert(named))
    names = groups["source"].to_pylist()
    totals, terms, kept = (groups[c].to_numpy() for c in ("total", "terms", "kept"))
    if len(names) > 1 and kept[0]:
        number = pa.compute.index_in(cells["source"], value_set=pa.array(names, pa.string())).to_numpy().astype(np.int64)
        value = joint_values(number, cells["count"].to_numpy(), cells["word"].to_numpy(),
                             cells["bits"].to_numpy().view(np.uint64), totals, int(terms[0]), int(kept[0]))
    else:
        value = np.zeros((len(names), len(names)), dtype=np.int64)
    a, b = np.nonzero(~np.eye(len(names), dtype=bool))
    own = pa.array(names, pa.string())
    return pa.table({"lang": pa.repeat(pa.scalar(key[0].as_py(), pa.string()), len(a)), "source": own.take(pa.array(a)),
                     "item": own.take(pa.array(b)), "value": pa.array(value[a, b], pa.int64())})


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank; see the module's docstring."""
    counts = written(term_counts(docs).groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs")), "divergence-counts")
    groups = counts.where("term IS NULL").select("lang", "source")
    terms = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(
        F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs")
    terms = written(terms, "divergence-terms")
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).join(
        terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total")), "lang", "left")
    langs = langs.fillna(0, ["kept", "lang_total"]).withColumn(
        "block_terms", F.greatest(F.lit(64), F.call_function("div", F.lit(BLOCK_ROWS), F.col("sources"))))
    langs = langs.withColumn("blocks", F.call_function("div", F.col("kept"), F.col("block_terms")) + 1).drop("block_terms")

    # Without this exchange the join's layout by language would serve the windows, too: a language in one task.
    blocks = terms.join(langs, "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks"))).repartition("lang", "block")
    place = Window.partitionBy("lang", "block").orderBy(F.desc("lang_n"), "term")
    blocks = blocks.withColumn("id", F.row_number().over(place) - 1)
    cells = written(counts.where("n > 0").select("lang", "source", "term", "n").join(
        blocks.select("lang", "term", "lang_n", "lang_total", "kept", "block", "id"), ["lang", "term"]), "divergence-cells")
    totals = groups.join(cells.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    totals = written(totals.fillna(0, ["total"]), "divergence-totals")

    word = F.call_function("div", F.col("id"), F.lit(64))
    bitmaps = cells.groupBy("lang", "block", "source", F.col("n").alias("count"), word.alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, int(id % 64)))").alias("bits"))
    sizes = blocks.groupBy("lang", "block").agg(F.count(F.lit(1)).alias("terms"))
    per_block = langs.select("lang", "kept", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    per_block = per_block.join(sizes, ["lang", "block"], "left").fillna(0, ["terms"])
    none = F.lit(0).cast("long")
    named = per_block.join(totals, "lang").select(
        "lang", "block", "source", *[none.alias(c) for c in ("count", "word", "bits")], "total", "terms", "kept")
    bitmaps = bitmaps.select("*", *[none.alias(c) for c in ("total", "terms", "kept")])
    pairs = bitmaps.unionByName(named).groupBy("lang", "block").applyInArrow(
        _pairs, "lang string, source string, item string, value long")
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))

    p = share_column(F.col("n"), F.col("total"), F.col("kept"))
    q = share_column(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    over = cells.join(totals, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q"))
    over = over.where("p > q").withColumn("value", F.expr("((p - q) * (p - q)) div (p + q)"))
    over = over.withColumn("rank", rank).where(F.col("rank") <= top)
    return pairs.unionByName(over.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents),
w AS (SELECT id, lang, source, unnest(ts) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 10),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(n) AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, source, term, count(*)::HUGEINT AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
t AS (SELECT lang, source, coalesce(sum(c.n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
s AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n,
             1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (t.total + 2 * l.v) AS p,
             1 + (1000000000 * (k.n + 2)) // (l.total + 2 * l.v) AS q
      FROM t JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
x AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
      FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
      UNION ALL
      SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM s WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value,
       row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank
FROM r QUALIFY part = 'pair' OR rank <= 10
"""
