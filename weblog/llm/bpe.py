"""Byte-level BPE encoding and decoding by recursive DuckDB queries per partition.

Each task holds one in-memory DuckDB with the merge table: a row for every pair of
tokens whose joined bytes are a token, with that token's rank. New words come in as
token-position rows, one per byte. A recursive query joins neighbouring rows with
the merge table, contracts each word's leftmost pair of least rank, and ends when no
word has a pair left. Decoding joins the ids with the vocabulary and concatenates the
bytes by an aggregation ordered by position.

Texts are split by the pattern first. A stretch between two single spaces splits on
its own wherever it stands, so encoded stretches are kept in a bounded memory per worker;
a text with unusual white space is split as a whole. Texts pass through in batches of
bounded size and nothing is shuffled.

Long words (over ``LONG`` bytes) take a second query, which contracts many pairs of a word in one step and still equals
one by one. A pair may be contracted at once if none of smaller rank starts within reach: until its turn, only tokens of no
higher rank are made, each such token that touches the pair would have to stretch from there, and none
is as long. So the reach is the length of the longest token of no higher rank, counted in rows (a token has a byte at least). Of pairs with equal ranks the overlapping ones
(a run of equal tokens) are taken alternately from the left; where a contracted token would itself have a pair of smaller
rank with what stands beside it, order matters among equal pairs: those to its right wait a step, and so
do those to the right of one that can't be contracted yet. Only the rows that a step has changed are joined
with the merge table again, all long words share the steps, and what no pair can reach any more is put aside.

Defined cases: a null text counts as empty; an empty text has no ids and the digest of no
bytes; repeated rows and null identifiers each give their row.
"""
from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from itertools import islice

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
import regex
from pyspark.sql import DataFrame, SparkSession

from weblog.llm import common
from weblog.llm.common import pick, portions, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
LONG = 256
#: Bytes of long words for one query, and memory of a worker's database.
LONG_BYTES, MEMORY_MB = 1 << 20, 600
#: Words for one query, bytes of text for one decoding, and stretches kept in a worker.
WORDS, TEXT_BYTES, KEPT = 20_000, 1 << 20, 900_000

#: One contraction per word and step. Rows whose word has no pair left come out as not live.
CONTRACT = """
WITH RECURSIVE state(w, p, t, live) AS (
  SELECT w, p, t, true FROM chars
  UNION ALL
  SELECT s.w, s.p,
         CASE WHEN s.p = (b.best >> 23) & 8388607 THEN (b.best >> 46)::INT ELSE s.t END,
         b.best IS NOT NULL
  FROM state s JOIN (
    SELECT w, min((m.r::BIGINT << 46) | (x.p::BIGINT << 23) | x.np) AS best
    FROM (SELECT w, p, t, lead(t) OVER o AS nt, lead(p) OVER o AS np
          FROM state WHERE live WINDOW o AS (PARTITION BY w ORDER BY p)) x
    LEFT JOIN merges m ON m.a = x.t AND m.b = x.nt GROUP BY w) b ON b.w = s.w
  WHERE s.live AND (b.best IS NULL OR s.p <> (b.best & 8388607)))
SELECT w, t FROM state WHERE NOT live ORDER BY w, p
"""

#: Many contractions per word and step: every pair that no contraction elsewhere can come to before its turn.
#: A row is a token (bytes p to e), the rank r of its pair with the next token, and the reach l of that rank.
#: It stops after some steps, so that the rows of all steps stay few; the caller goes on.
CONTRACT_LONG = """
WITH RECURSIVE state(step, w, p, e, t, r, l, k) AS (
  SELECT 0, w, p, e, t, r, l, k FROM tokens
  UNION ALL
  (WITH near AS MATERIALIZED (
     SELECT w, p, e, t, r, l, k, lag(r) OVER o AS pr, lag(t) OVER o AS pt, lead(t, 2) OVER o AS nnt,
            row_number() OVER o AS i, min(r) OVER (PARTITION BY w ORDER BY p
                         ROWS BETWEEN coalesce(l, 0) PRECEDING AND coalesce(l, 0) + 1 FOLLOWING) AS least_
     FROM state WINDOW o AS (PARTITION BY w ORDER BY p)),
   turn AS MATERIALIZED (
     SELECT w, p, k
     FROM (SELECT *, row_number() OVER q AS place, first_value(head) OVER q AS whole
           FROM (SELECT *, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY w ORDER BY p ROWS UNBOUNDED PRECEDING) AS run
                 FROM (SELECT *, coalesce(pr <> r, true) AS head,
                              coalesce(pr = r AND lag(e) OVER (PARTITION BY w ORDER BY p) = p, false) AS joined
                       FROM near WHERE r = least_))
           WINDOW q AS (PARTITION BY w, run ORDER BY p))
     WHERE whole AND place % 2 = 1),
   risky AS (
     SELECT s.w, s.p, s.r, s.l, s.i, t.p IS NOT NULL AS turn,
            s.r <> s.least_ OR coalesce(least(x.r, y.r, z.r) < s.r, false) AS source
     FROM (SELECT * FROM near WHERE k) s
     LEFT JOIN turn t ON t.w = s.w AND t.p = s.p
     LEFT JOIN merges x ON x.a = CASE WHEN t.p IS NOT NULL THEN s.pt END AND x.b = s.r
     LEFT JOIN merges y ON y.a = CASE WHEN t.p IS NOT NULL THEN s.r END AND y.b = s.nnt
     LEFT JOIN merges z ON z.a = CASE WHEN t.p IS NOT NULL THEN s.r END AND z.b = s.r),
   hits AS MATERIALIZED (
     SELECT w, p FROM turn WHERE NOT k
     UNION ALL
     SELECT w, p
     FROM (SELECT *, bool_or(source) OVER (PARTITION BY w, r, chain ORDER BY i
                                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS waits
           FROM (SELECT *, sum(far) OVER (PARTITION BY w, r ORDER BY i ROWS UNBOUNDED PRECEDING) AS chain
                 FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY w, r ORDER BY i) <= l + 1 THEN 0 ELSE 1 END AS far
                       FROM risky)))
     WHERE turn AND waits IS NOT TRUE)
   SELECT step, c.w, c.p, c.e, c.t, CASE WHEN changed THEN m.r ELSE c.r END, CASE WHEN changed THEN m.l ELSE c.l END,
          CASE WHEN changed THEN m.k ELSE c.k END
   FROM (SELECT step, w, p, CASE WHEN hit THEN lead(e) OVER o ELSE e END AS e, CASE WHEN hit THEN r ELSE t END AS t, r, l, k,
                lag(hit) OVER o AS eaten, hit OR coalesce(lead(hit) OVER o, false) AS changed,
                CASE WHEN NOT hit THEN lead(r) OVER o
                     WHEN lead(p, 2) OVER o = lead(e) OVER o
                     THEN CASE WHEN lead(hit, 2) OVER o THEN lead(r, 2) OVER o ELSE lead(t, 2) OVER o END END AS nt
         FROM (SELECT s.*, h.p IS NOT NULL AS hit, (SELECT max(step) + 1 FROM state) AS step
               FROM (SELECT w, p, e, t, r, l, k FROM near WHERE (SELECT count(*) FROM hits) > 0 AND (SELECT max(step) FROM state) < $steps) s
               LEFT JOIN hits h ON h.w = s.w AND h.p = s.p)
         WINDOW o AS (PARTITION BY w ORDER BY p)) c
   LEFT JOIN merges m ON m.a = CASE WHEN changed THEN c.t END AND m.b = c.nt
   WHERE c.eaten IS NOT TRUE))
SELECT w, p, e, t, r, l, k,
       min(r) OVER (PARTITION BY w ORDER BY p ROWS BETWEEN $far PRECEDING AND $far FOLLOWING) IS NOT NULL AS live
FROM state WHERE step = (SELECT max(step) FROM state) ORDER BY w, p
"""

#: The first rows of long words: one token per byte.
FIRST = """
SELECT w, p, p + 1 AS e, t, m.r, m.l, m.k
FROM (SELECT *, lead(t) OVER (PARTITION BY w ORDER BY p) AS nt FROM chars) c LEFT JOIN merges m ON m.a = c.t AND m.b = c.nt
"""

DECODE = """
SELECT d, list(b ORDER BY p) AS bs FROM ids JOIN vocab USING (id) GROUP BY d
"""


class Coder:
    """Encoder and decoder of one worker process."""

    def __init__(self, path: str, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.split = regex.compile(pattern).findall
        self.byte_id = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": f"{MEMORY_MB}MB", "temp_directory": "",
                                          "allocator_flush_threshold": "8MB"})
        pairs = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items()
                 for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        m = np.array(pairs, dtype=np.int32).reshape(-1, 3)
        # The longest token of no higher rank, and whether the contracted token is part of a pair of smaller rank.
        longest = np.zeros(max(self.ranks.values(), default=0) + 1, dtype=np.int32)
        for t, r in self.ranks.items():
            longest[r] = len(t)
        longest = np.maximum.accumulate(longest)
        self.far = 2 * int(longest[-1])
        part = {x for a, b, r in pairs for x in (a, b) if r < x}
        self._load("merges", {"a": m[:, 0], "b": m[:, 1], "r": m[:, 2], "l": longest[m[:, 2]],
                              "k": [r in part for r in m[:, 2].tolist()]})
        self._load("vocab", {"id": pa.array(list(self.ranks.values()), pa.int32()),
                             "b": pa.array(list(self.ranks), pa.binary())})
        self.spaced: dict[str, bytes] = {}  # stretches that follow a space, with it
        self.plain: dict[str, bytes] = {}  # anything split as it stands

    def _load(self, name: str, columns: dict | pa.Table) -> None:
        self.db.register("given", pa.table(columns) if isinstance(columns, dict) else columns)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct words as little-endian 32-bit integers."""
        coded, rest, long = {}, [], []
        for w in words:
            b = w.encode()
            if (i := self.ranks.get(b)) is not None:
                coded[w] = i.to_bytes(4, "little")
            else:
                (long if len(b) > LONG else rest).append((w, b))
        for x, y in portions([b for _, b in long], LONG_BYTES):
            coded.update(zip([w for w, _ in long[x:y]], self._long([b for _, b in long[x:y]])))
        for k in range(0, len(rest), WORDS):
            part = rest[k:k + WORDS]
            self._chars([b for _, b in part])
            got = self.db.execute(CONTRACT).fetchnumpy()
            ids = got["t"].astype("<u4").tobytes()
            ends = (4 * np.searchsorted(got["w"], np.arange(len(part) + 1))).tolist()
            coded.update((w, ids[a:b]) for (w, _), a, b in zip(part, ends, ends[1:]))
        return coded

    def _chars(self, words: list[bytes]) -> None:
        n = np.array([len(b) for b in words])
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        at = np.arange(len(raw)) - np.repeat(np.cumsum(n) - n, n)
        self._load("chars", {"w": np.repeat(np.arange(len(words), dtype=np.int32), n),
                             "p": at.astype(np.int32), "t": self.byte_id[raw]})

    def _long(self, words: list[bytes]) -> list[bytes]:
        """Ids of long words, which share their steps. Rows that nothing can reach any more are put aside between queries."""
        size = sum(map(len, words))
        if size > LONG_BYTES:  # a single longer word: memory in proportion to it
            self.db.execute(f"SET memory_limit='{MEMORY_MB + size * MEMORY_MB // LONG_BYTES}MB'")
        self._chars(words)
        tokens, done = self.db.sql(FIRST).to_arrow_table(), []
        while len(tokens):
            self._load("tokens", tokens)
            steps = max(1, min(16, 4 * LONG_BYTES // len(tokens)))
            got = self.db.sql(CONTRACT_LONG, params={"steps": steps, "far": self.far}).to_arrow_table()
            live = got["live"].combine_chunks()
            done.append(got.filter(pa.compute.invert(live)).select(["w", "p", "t"]))
            tokens = got.filter(live).drop_columns(["live"])
        if size > LONG_BYTES:
            self.db.execute(f"SET memory_limit='{MEMORY_MB}MB'")
        rows = pa.concat_tables(done)
        w, p, t = (rows[c].to_numpy() for c in ("w", "p", "t"))
        by = np.lexsort((p, w))
        ends = np.searchsorted(w[by], np.arange(len(words) + 1))
        ids = t[by].astype("<u4")
        return [ids[a:b].tobytes() for a, b in zip(ends, ends[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.spaced) + len(self.plain) > KEPT:
            self.spaced, self.plain = {}, {}
        parts = [t.split(" ") for t in texts]
        seen: set[str] = set()
        for p in parts:
            seen.update(islice(p, 1, None))
        new = seen.difference(self.spaced)  # looks up each that was seen; "- keys()" would walk through all that are kept
        odd = {s for s in new if not s or s[0].isspace() or s[-1].isspace()}
        whole = []  # texts that can't be cut at their spaces
        first = set()
        for t, p in zip(texts, parts):
            edge = not p[0] or p[0][0].isspace() or p[0][-1].isspace()
            if len(p) > 1 and (edge or odd and not odd.isdisjoint(p[1:])):
                whole.append(t)
            else:
                first.add(p[0])
        cut = set(whole)
        cuts = {(" ", s): self.split(" " + s) for s in new - odd}
        cuts |= {("", s): self.split(s) for s in first if s not in self.plain}
        long = {t: self.split(t) for t in cut}
        coded = self.words(list({w for ws in (*cuts.values(), *long.values()) for w in ws}))
        for (lead, s), ws in cuts.items():
            (self.spaced if lead else self.plain)[s] = b"".join([coded[w] for w in ws])
        spaced = self.spaced
        return [b"".join([coded[w] for w in long[t]]) if t in cut
                else self.plain[p[0]] + b"".join(map(spaced.__getitem__, islice(p, 1, None))) for t, p in zip(texts, parts)]

    def decode(self, coded: list[bytes]) -> list[bytes]:
        n = np.array([len(c) // 4 for c in coded])
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.db.register("ids", pa.table({
            "d": np.repeat(np.arange(len(coded), dtype=np.int32), n), "p": at.astype(np.int32),
            "id": np.frombuffer(b"".join(coded), dtype="<u4").astype(np.int32)}))
        got = self.db.sql(DECODE).to_arrow_table()
        out = [b""] * len(coded)
        for batch in got.to_batches():
            lists = batch.column(1)
            tokens = lists.values.cast(pa.large_binary())
            # The bytes of consecutive tokens lie side by side in the array's buffer.
            edge = np.frombuffer(tokens.buffers()[1], dtype=np.int64)[tokens.offset:tokens.offset + len(tokens) + 1]
            cut, data = edge[lists.offsets.to_numpy()], tokens.buffers()[2]
            for d, a, b in zip(batch.column(0).to_pylist(), cut, cut[1:]):
                out[d] = data[a:b].to_pybytes()
        return out


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> Coder:
    return Coder(path, pattern)


common.KEPT["bpe"] = coder.cache_clear


def public_vocabulary() -> tuple[str, str]:
    """Place of the public rank file and its pattern."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


def tokenize(docs: DataFrame, path: str | None = None, pattern: str | None = None, ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (if asked for), ids_sha256, decoded_sha256 of each document.

    The digests are those of the ids as little-endian 32-bit integers, and of the
    bytes that the ids decode to.
    """
    if path is None or pattern is None:
        path, pattern = public_vocabulary()
    given = pick(docs, doc_id="doc_id", text="text")

    def run(batches):
        own = coder(path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, (a, b) in enumerate(portions(texts, TEXT_BYTES)):
                if i % 4 == 3:
                    common.release()
                coded = own.encode(texts[a:b])
                columns = [batch.column(0).slice(a, b - a).cast(pa.int64()),
                           pa.array([len(c) // 4 for c in coded], pa.int64())]
                if ids:
                    columns.append(pa.array([np.frombuffer(c, dtype="<u4").astype(np.int32) for c in coded],
                                            pa.list_(pa.int32())))
                columns += [pa.array([hashlib.sha256(c).hexdigest() for c in coded]),
                            pa.array([hashlib.sha256(d).hexdigest() for d in own.decode(coded)])]
                yield pa.RecordBatch.from_arrays(columns, names)
        common.release()

    names = ["doc_id", "n_tokens", *["ids"] * ids, "ids_sha256", "decoded_sha256"]
    schema = "doc_id long, n_tokens long" + ", ids array<int>" * ids + ", ids_sha256 string, decoded_sha256 string"
    return given.mapInArrow(run, schema)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(table(spark, sf_dir, "documents"), ids=False)
