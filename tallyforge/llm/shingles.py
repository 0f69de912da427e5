"""Word shingles of UTF-8 texts as 64-bit hashes, set fingerprints and minhash keys, computed for many texts at a time."""

from __future__ import annotations

import numpy as np
import xxhash

_U = np.uint64
_ODD, _STEP = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: shifts and odd multiplications."""
    x = (x ^ (x >> _U(30))) * _STEP
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class WordHashes(dict):
    """Word to 64-bit hash; starts anew at ``limit`` words."""

    def __init__(self, limit: int = 80_000):
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def words_of(text: bytes) -> list[bytes]:
    """A-Z lower-cased, parted at space and 0x09-0x0D."""
    return text.lower().split()


def shingle_set(text: bytes, width: int) -> set[tuple[bytes, ...]]:
    """The shingles themselves, for exact comparison."""
    words = words_of(text)
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(width)), strict=False))


def hashed_sets(texts: list[bytes], width: int, table: WordHashes) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out = []
    for text in texts:
        words = words_of(text)
        h = np.fromiter(map(table.__getitem__, words), _U, len(words))
        span = min(width, len(h))
        if not span:
            out.append(h)
            continue
        acc = h[: len(h) - span + 1].copy()
        for i in range(1, span):
            acc = mix(acc * _ODD + h[i : len(h) - span + 1 + i])
        out.append(np.unique(mix(acc + _U(span))))
    return out


def fingerprints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit digests of each set."""
    return np.array([mix(s ^ _ODD).sum(dtype=_U) for s in sets], _U), np.array([np.bitwise_xor.reduce(mix(s + _ODD)) if len(s) else 0 for s in sets], _U)


def minhash_keys(sets: list[np.ndarray], collections: int, per_collection: int, rows: int, seed: int = 1, chunk: int = 32_768) -> np.ndarray:
    """(texts, collections * per_collection) keys, each joining ``rows`` minhashes. Sets must not be empty."""
    n_keys = collections * per_collection
    rng = np.random.default_rng(seed)
    xors, odds = rng.integers(0, 2**64, (2, n_keys * rows), dtype=_U)
    odds |= _U(1)
    out = np.empty((len(sets), n_keys), _U)
    at = 0
    while at < len(sets):
        to, held = at, 0
        while to < len(sets) and (to == at or held + len(sets[to]) <= chunk):
            held += len(sets[to])
            to += 1
        flat = np.concatenate(sets[at:to])
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[at : to - 1]])]).astype(np.int64)
        for k in range(n_keys):
            key = np.full(to - at, k, _U)
            for f in range(k * rows, k * rows + rows):
                key = mix(key * _ODD + np.minimum.reduceat((flat ^ xors[f]) * odds[f], starts))
            out[at:to, k] = key
        at = to
    return out
