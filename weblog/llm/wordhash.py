"""Vectorised word and shingle hashes of many texts at once (numpy, inside tasks).

Words are ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 bytes; A-Z count as a-z. A word's hash is a
polynomial over a random byte table, so all words of a batch come from one running sum;
a mixer spreads it over 64 bits.
"""
from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.Philox(key=[2, 71]))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_BASE = int(_RNG.integers(1, 2**61)) * 8 + 5
_INVERSE = pow(_BASE, -1, 2**64)
IS_WHITE = np.zeros(256, dtype=bool)
IS_WHITE[[32, *range(9, 14)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the finaliser of splitmix64; fixed constants)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


KEPT_POWERS = 1 << 20
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; kept up to ``KEPT_POWERS`` numbers, beyond them made anew."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.ones(max(n, 1 << 16), dtype=np.uint64)
        have[1:] = np.uint64(base)
        have = np.multiply.accumulate(have)
        if n <= KEPT_POWERS:
            _POWERS[base] = have
    return have[:n]


def word_hashes(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, in order, and for each text the end of its words.

    ``raw`` holds the bytes of all texts, each followed by one white byte; ``ends`` where each
    text's stretch ends, that byte included.
    """
    word = ~IS_WHITE[raw]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if len(raw) and word[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * powers(_BASE, len(raw)), out=total[1:])
    h = (total[end] - total[start]) * powers(_INVERSE, len(raw))[start]
    h = mix64(h ^ (end - start).astype(np.uint64))
    return h, np.searchsorted(start, ends)


def joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and ends of the texts, as ``word_hashes`` takes them."""
    parts = [(t or "").encode() for t in texts]
    ends = np.cumsum([len(p) + 1 for p in parts], dtype=np.int64)
    return np.frombuffer(b" ".join([*parts, b""]), dtype=np.uint8), ends


def shingle_sets(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-word shingles of every text, sorted, and where each text's end.

    A text of fewer than n words has its whole sequence as one shingle; without
    words it has none.
    """
    words, ends = word_hashes(*joined(texts))
    counts = np.diff(ends, prepend=0)
    rolled = np.zeros(len(words), dtype=np.uint64)
    for k in range(n):
        # Positions near the end read past their text; those shingles are dropped below.
        rolled[:len(words) - k] = mix64(rolled[:len(words) - k] * np.uint64(0x9E3779B97F4A7C15) + words[k:]) if k else words
    first = ends - counts
    kept = np.maximum(counts - n + 1, 0)
    own = np.repeat(first, kept) + np.arange(kept.sum()) - np.repeat(np.cumsum(kept) - kept, kept)
    shingles, text = rolled[own], np.repeat(np.arange(len(texts)), kept)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        whole = np.zeros(len(short), dtype=np.uint64)
        for j, i in enumerate(short):
            h = np.array([counts[i]], dtype=np.uint64)
            for w in words[first[i]:ends[i]]:
                h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + w)
            whole[j] = h[0]
        shingles, text = np.concatenate([shingles, whole]), np.concatenate([text, short])
    order = np.lexsort((shingles, text))
    shingles, text = shingles[order], text[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (shingles[1:] != shingles[:-1])
    shingles, text = shingles[new], text[new]
    return shingles, np.searchsorted(text, np.arange(len(texts)), side="right")
