"""Word shingles and MinHash values as numpy arrays, worked out for many texts at once."""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import xxhash

from tessera.llm.common import WORD

N = 5
_WORD = re.compile(WORD)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hash of each word, kept while a task runs and emptied when large."""

    def __missing__(self, w: str) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


def scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(27))


def shingles(texts, known: WordHashes, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all n-word shingles of all texts in order, how many each text has).

    A text of one to n - 1 words has one shingle, all its words; a null or blank text has none.
    """
    lists = [_WORD.findall(t) if t else [] for t in texts]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    h = np.fromiter(map(known.__getitem__, chain.from_iterable(lists)), np.uint64, int(sizes.sum()))
    ends = np.cumsum(sizes)
    if len(h) >= n:
        g = np.zeros(len(h) - n + 1, np.uint64)
        for i in range(n):
            g = g * _MIX + h[i : i + len(g)]
        g = scramble(np.r_[g, np.zeros(n - 1, np.uint64)])
    else:
        g = np.zeros(len(h), np.uint64)
    counts = np.where(sizes >= n, sizes - n + 1, np.minimum(sizes, 1))
    starts = ends - sizes
    for d in np.flatnonzero((sizes > 0) & (sizes < n)):
        x = np.uint64(sizes[d])
        with np.errstate(over="ignore"):
            for w in h[starts[d] : ends[d]]:
                x = x * _MIX + w
        g[starts[d]] = scramble(np.array([x]))[0]
    inside = np.arange(len(h)) - np.repeat(starts, sizes) < np.repeat(counts, sizes)
    return g[inside], counts


def multipliers(k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.RandomState(seed)
    a = r.randint(0, 2**63 - 1, k, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    return a, r.randint(0, 2**63 - 1, k, dtype=np.int64).astype(np.uint64)


def minima(values: np.ndarray, starts: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """k rows of MinHash values, one column per run of values that begins at starts (runs are not empty)."""
    a, b = multipliers(k, seed)
    out = np.empty((k, len(starts)), np.uint64)
    for i in range(k):
        x = values * a[i] + b[i]
        x ^= x >> np.uint64(32)
        out[i] = np.minimum.reduceat(x, starts)
    return out


def chunks(texts, chars: int = 2_000_000):
    """Slices of a list of texts with about so many characters; one longer text stands alone."""
    a = held = 0
    for i, t in enumerate(texts):
        held += len(t) if t else 0
        if held > chars:
            yield slice(a, i + 1)
            a, held = i + 1, 0
    if a < len(texts):
        yield slice(a, len(texts))


def minima32(values: np.ndarray, starts: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """As minima, with 32-bit values: cheaper, for runs far shorter than 2^32."""
    a, b = (x.astype(np.uint32) for x in multipliers(k, seed))
    low = (values >> np.uint64(16)).astype(np.uint32)
    out = np.empty((k, len(starts)), np.uint32)
    for i in range(k):
        x = low * (a[i] | np.uint32(1))
        x += b[i]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(13)
        out[i] = np.minimum.reduceat(x, starts)
    return out
