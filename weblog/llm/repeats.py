"""Removal of long repeated passages by run-length (run-compressed BWT) indexes.

A byte goes if a string of ``LENGTH`` bytes that covers it starts anywhere else, too.

1. Windows of LENGTH bytes are dealt by content: a window's anchor is the least hash among the ``GRAM``-byte
   strings in it. Neighbouring windows with the same anchor make a context; every window lies in
   exactly one context, and equal windows have equal anchors, wherever they are.
2. A context that occurs twice (192 bits: its anchor and two content hashes) is repeated as a whole; copies collapse map-side. Only contexts whose anchor has
   other contexts, or that may repeat inside themselves, go on, one of each content.
3. These are shuffled by anchor. A task joins the contexts of whole anchors up to ``INDEX_BYTES``, sorts the suffixes and keeps
   the run-compressed Burrows-Wheeler transform: for each run its symbol and length, the text
   positions of its two ends, and there the common prefix with the neighbouring suffix. Matching
   statistics of the text against all other positions stream from these samples: behind a
   sampled position they fall by one per byte. Windows whose statistic reaches LENGTH are repeated.
4. An anchor that has more than ``HOT_BYTES`` of different contexts would not fit a task. Its contexts go through steps 1 to 3 again
   with anchors ``LONGER`` times as long, which deal their windows out further. Where such an anchor is as hot again, its windows are counted one by
   one by a 128-bit hash, pre-aggregated map-side. All ways find the same windows.
5. Repeated windows become byte ranges of the documents, which are cut out in one last pass.

Defined cases: a null text counts as empty; texts under LENGTH bytes keep everything; a text that occurs twice, or a
repeated row, loses everything if it has LENGTH bytes; a null or repeated doc_id is like any other (rows are told apart by their place).
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblog.llm.common import placed, portions, table, written
from weblog.llm.wordhash import mix64, powers

LENGTH, GRAM, LONGER = 400, 32, 4
#: Small batches of anchors, whose suffixes are sorted in the processor's cache.
INDEX_BYTES, HOT_BYTES, PORTION = 1 << 16, 8 << 20, 1 << 18

_RNG = np.random.Generator(np.random.Philox(key=[3, 400]))
_TABLES = _RNG.integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = [int(x) * 8 + 5 for x in _RNG.integers(1, 2**60, 2)]


def _sliding(x: np.ndarray, w: int, of, fill) -> np.ndarray:
    """Minimum or maximum (``of``) of x[i:i + w] for every full window, by block-wise running values."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, fill, dtype=x.dtype)
    padded[:len(x)] = x
    blocks = padded.reshape(-1, w)
    ahead = of.accumulate(blocks, axis=1).ravel()
    back = of.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return of(back[:n], ahead[w - 1:w - 1 + n])


def _rolled(raw: np.ndarray, k: int) -> np.ndarray:
    """Running polynomial sums from which any substring's hash follows."""
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_TABLES[k][raw] * powers(_BASES[k], len(raw)), out=total[1:])
    return total


def substring_hashes(total: np.ndarray, start: np.ndarray, end: np.ndarray, k: int) -> np.ndarray:
    back = powers(pow(_BASES[k], -1, 2**64), len(total))
    return mix64((total[end] - total[start]) * back[start] ^ (end - start).astype(np.uint64))


def contexts(raw: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Contexts of the texts that end at ``ends``: text, start (in raw), windows, anchor, content, check, inner.

    ``inner`` tells that the anchor occurs twice in the context, so a window may repeat inside it.
    """
    starts = np.concatenate([[0], ends[:-1]])
    windows = np.maximum(ends - starts - length + 1, 0)
    if not windows.any():
        return [np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint64, bool)]
    total = _rolled(raw, 0)
    at = np.arange(len(raw) - gram + 1)
    h = substring_hashes(total, at, at + gram, 0)
    w = length - gram + 1
    least = _sliding(h, w, np.minimum, np.uint64(2**64 - 1))
    valid = np.repeat(starts, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    text = np.repeat(np.arange(len(ends)), windows)
    value = least[valid]
    new = np.ones(len(valid), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    count = np.diff(first, append=len(valid))
    start, anchor = valid[first], value[first]
    # Positions that are the least of some window, and how many of them each context has.
    reach = np.zeros(len(raw) + w, dtype=np.uint64)
    reach[valid + w - 1] = value
    highest = _sliding(np.concatenate([reach, np.zeros(w, dtype=np.uint64)]), w, np.maximum, np.uint64(0))
    # reach[s + w - 1] is the least of window s; positions p lie in the windows p - w + 1 .. p.
    place = np.flatnonzero(h == highest[:len(h)])
    low, high = np.searchsorted(place, start), np.searchsorted(place, start + count + w - 1)
    n = high - low
    each = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    owner = np.repeat(np.arange(len(start)), n)
    hits = np.bincount(owner, weights=h[place[each]] == anchor[owner], minlength=len(start))
    end = start + count + length - 1
    return (text[first], start, count, anchor, substring_hashes(total, start, end, 0),
            substring_hashes(_rolled(raw, 1), start, end, 1), hits > 1)


class RunIndex:
    """Run-compressed BWT of a text with samples at run ends."""

    def __init__(self, text: np.ndarray):
        """``text``: symbols 1..256, with 0 between pieces."""
        order, levels = self._suffixes(text)
        before = np.where(order > 0, text[order - 1], -1)
        head = np.ones(len(order), dtype=bool)
        head[1:] = before[1:] != before[:-1]
        tail = np.append(head[1:], True)
        self.symbols, at = before[head], np.flatnonzero(head)
        self.lengths = np.diff(at, append=len(order))
        self.n = len(order)
        # Samples: positions at run heads (tails) and the common prefix with the suffix before (behind).
        j, k = np.flatnonzero(head), np.flatnonzero(tail)
        up, down = (order[j], order[j - 1]), (order[k], order[(k + 1) % len(order)])
        up, down = self._common(text, *up, levels), self._common(text, *down, levels)
        up[0] = down[-1] = 0
        self.heads, self.tails = (order[j], up), (order[k], down)

    @staticmethod
    def _suffixes(text: np.ndarray) -> tuple[np.ndarray, list]:
        """Suffix order, and the ranks of substrings by length, by prefix doubling."""
        n = len(text)
        key = np.zeros(n, dtype=np.int64)
        for k in range(7):  # seven symbols of nine bits
            key[:n - k] |= text[k:].astype(np.int64) + 1 << 9 * (6 - k)
        levels, size = [], 7
        while True:
            order = np.argsort(key, kind="stable")
            new = np.ones(n, dtype=bool)
            new[1:] = key[order[1:]] != key[order[:-1]]
            rank = np.empty(n, dtype=np.int32)
            rank[order] = np.cumsum(new)
            levels.append((size, rank))
            if new.all() or size >= n:
                return order, levels
            further = np.zeros(n, dtype=np.int64)
            further[:max(0, n - size)] = rank[size:]
            key = rank.astype(np.int64) * (n + 1) + further
            size *= 2

    @staticmethod
    def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, levels: list) -> np.ndarray:
        """Lengths of common prefixes of suffixes, from the longest substrings of equal rank down to symbols."""
        n, done = len(text), np.zeros(len(a), dtype=np.int64)
        for size, rank in [*reversed(levels), *[(1, text)] * 6]:
            x, y = a + done, b + done
            inside = (x < n) & (y < n)
            done += np.where(inside & (rank[np.minimum(x, n - 1)] == rank[np.minimum(y, n - 1)]), size, 0)
        return done

    def matching_statistics(self) -> np.ndarray:
        """For every text position, the longest match that starts at another position.

        Behind a sampled position the match with that neighbour is shorter by one per
        symbol, up to the next sample.
        """
        out = np.zeros(self.n, dtype=np.int64)
        for place, common in (self.heads, self.tails):
            by = np.argsort(place)
            place, common = place[by], common[by]
            last = np.searchsorted(place, np.arange(self.n), side="right") - 1
            out = np.maximum(out, common[last] - (np.arange(self.n) - place[last]))
        return out


def repeated_windows(pieces: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For every piece, which of its windows of ``length`` bytes occur at another place of the pieces."""
    sizes = np.array([len(p) + 1 for p in pieces])
    text = np.zeros(sizes.sum(), dtype=np.int16)
    ends = np.cumsum(sizes)
    for p, end in zip(pieces, ends):
        text[end - len(p) - 1:end - 1] = np.frombuffer(p, dtype=np.uint8)
        text[end - len(p) - 1:end - 1] += 1
    found = RunIndex(text).matching_statistics() >= length
    return [found[end - len(p) - 1:end - length] for p, end in zip(pieces, ends)]


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last place of every run of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[0::2].tolist(), (edge[1::2] - 1).tolist()))


KEY = ["k1", "k2", "k3"]
CONTENT = ["anchor", "content", "check"]


def located(given: DataFrame, length: int, gram: int) -> DataFrame:
    """The key, start, windows, anchor, content, check, inner of every context of k1, k2, k3, raw (bytes)."""
    def run(batches):
        for batch in batches:
            raws = [r or b"" for r in batch.column(3).to_pylist()]
            for a, b in portions(raws, PORTION):
                part = raws[a:b]
                ends = np.cumsum([len(t) for t in part])
                text, start, count, *found = contexts(np.frombuffer(b"".join(part), dtype=np.uint8), ends, length, gram)
                first = np.concatenate([[0], ends[:-1]])
                at = pa.array(text)
                yield pa.RecordBatch.from_arrays([
                    *[batch.column(k).slice(a, b - a).take(at) for k in range(3)],
                    pa.array(start - first[text], pa.int64()), pa.array(count, pa.int64()),
                    *[pa.array(h.view(np.int64)) for h in found[:3]], pa.array(found[3])], names)

    names = [*KEY, "start", "windows", *CONTENT, "inner"]
    return given.mapInArrow(run, ", ".join(f"{c} long" for c in names[:-1]) + ", inner boolean")


def _pieces(given: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """anchor, content, check, copies, piece (the bytes) of the contexts wanted, from one text that has each."""
    per_text = wanted.groupBy(*KEY).agg(F.collect_list(F.struct("start", "windows", *CONTENT, "copies")).alias("wanted"))
    found = given.join(per_text, KEY).select("raw", "wanted")

    def run(batches):
        for batch in batches:
            rows = []
            for raw, cuts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += [(c["anchor"], c["content"], c["check"], c["copies"], raw[c["start"]:c["start"] + c["windows"] + length - 1])
                         for c in cuts]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.int64()] * 4 + [pa.binary()])],
                [*CONTENT, "copies", "piece"])

    return found.mapInArrow(run, "anchor long, content long, check long, copies long, piece binary")


def _indexed(pieces: DataFrame, length: int) -> DataFrame:
    """anchor, content, check, first, last: runs of repeated windows, by an index over the contexts of whole anchors."""
    def run(batches):
        held, size = [], 0

        def out():
            rows = []
            for (*content, copies, _), flags in zip(held, repeated_windows([h[4] for h in held], length)):
                if copies == 1:  # of others every window is known to repeat
                    rows += [(*content, a, b) for a, b in _runs(flags)]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], names)

        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                if held and row[0] != held[-1][0] and size > INDEX_BYTES:
                    yield out()
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield out()

    names = [*CONTENT, "first", "last"]
    return pieces.repartition("anchor").sortWithinPartitions(*CONTENT).mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _counted(pieces: DataFrame, length: int) -> DataFrame:
    """The same runs for anchors that are still too hot for one task: windows counted by a 128-bit hash."""
    def run(batches):
        for batch in batches:
            for *content, copies, piece in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                raw = np.frombuffer(piece, dtype=np.uint8)
                at = np.arange(len(raw) - length + 1)
                h = [substring_hashes(_rolled(raw, k), at, at + length, k).view(np.int64) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([
                    *map(pa.array, h), *[pa.array(np.full(len(at), c)) for c in (*content, copies)], pa.array(at)], names)

    names = ["h", "g", *CONTENT, "copies", "at"]
    windows = written(pieces.mapInArrow(run, ", ".join(f"{c} long" for c in names)), "repeat-windows")
    often = windows.groupBy("h", "g").agg(F.sum("copies").alias("n")).where("n > 1").select("h", "g")
    return windows.where("copies = 1").join(often, ["h", "g"]).select(
        *CONTENT, F.col("at").alias("first"), F.col("at").alias("last"))


def marked(given: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """k1, k2, k3, first, last: runs of windows (by their first bytes) of k1, k2, k3, raw that occur anywhere else.

    The contexts of an anchor with over ``hot_bytes`` of different contexts are texts of their own,
    which anchors of ``LONGER`` times the length deal out again, up to half a window.
    """
    rows = written(located(given, length, gram), "repeat-contexts")
    each = written(rows.groupBy(*CONTENT).agg(
        F.count(F.lit(1)).alias("copies"), F.max("inner").alias("inner"),
        F.min(F.struct(*KEY, "start", "windows")).alias("one")), "repeat-contents")
    anchors = each.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("contents"), F.max("inner").alias("any_inner"),
        F.sum(F.col("one.windows") + (length - 1)).alias("bytes")).where("contents > 1 OR any_inner")
    wanted = written(each.join(anchors, "anchor").select(
        *CONTENT, "copies", *[f"one.{k}" for k in KEY], "one.start", "one.windows",
        (F.col("bytes") > hot_bytes).alias("hot")), "repeat-wanted")
    marks = _indexed(_pieces(given, wanted.where("NOT hot"), length), length)
    if not wanted.where("hot").isEmpty():
        pieces = written(_pieces(given, wanted.where("hot"), length), "repeat-pieces")
        if LONGER * gram <= length // 2:
            finer = pieces.select(*[F.col(c).alias(k) for c, k in zip(CONTENT, KEY)], F.col("piece").alias("raw"))
            marks = marks.unionByName(marked(finer, length, LONGER * gram, hot_bytes).toDF(*CONTENT, "first", "last"))
        else:
            marks = marks.unionByName(_counted(pieces, length))
    whole = each.where("copies > 1").select(*CONTENT, F.lit(0).cast("long").alias("first"), (F.col("one.windows") - 1).alias("last"))
    marks = written(marks.unionByName(whole), "repeat-marks")
    return rows.join(marks, CONTENT).select(
        *KEY, (F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("last")).alias("last"))


def cut(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, spans (maximal removed byte ranges), kept (the bytes left), text
    (what is left as a string; a character that was cut in half shows as U+FFFD)."""
    at = {name: f"c{docs.columns.index(name)}" for name in ("doc_id", "text")}
    # A row's own place is its key (files by 128 bits of hash), so null and repeated ids don't matter.
    given = placed(docs).select(
        F.xxhash64("file").alias("k1"), F.col("row").alias("k2"), F.xxhash64(F.lit("file"), "file").alias("k3"),
        F.col(at["doc_id"]).cast("long").alias("doc_id"), F.coalesce(F.col(at["text"]), F.lit("")).cast("binary").alias("raw"))
    spans = written(marked(given.select(*KEY, "raw"), length, gram, hot_bytes).groupBy(*KEY).agg(
        F.collect_list(F.struct("first", (F.col("last") + length).alias("end"))).alias("spans")), "repeat-spans")
    both = given.join(spans, KEY, "left").select("doc_id", "raw", "spans")

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, raw, spans in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                merged = []
                for a, b in sorted((s["first"], s["end"]) for s in spans or ()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                edges = [0, *[x for m in merged for x in m], len(raw)]
                left = b"".join(raw[a:b] for a, b in zip(edges[0::2], edges[1::2]))
                rows.append({"doc_id": doc_id, "n_bytes": len(raw), "n_removed": len(raw) - len(left),
                             "spans": [{"first": a, "end": b} for a, b in merged], "kept": left, "text": left.decode("utf-8", "replace")})
                if len(rows) == 256:
                    yield pa.RecordBatch.from_pylist(rows, arrow)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, arrow)

    arrow = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                       ("spans", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary()), ("text", pa.string())])
    return both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, "
                                "spans array<struct<first:bigint,end:bigint>>, kept binary, text string")


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Besides the contract's columns: the removed spans, and the text that is left."""
    return cut(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"), "spans", "text")
