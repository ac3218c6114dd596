"""Shingle sets and one-permutation MinHash signatures, on the workers; numpy and xxhash only."""

from __future__ import annotations

import numpy as np
import xxhash

# Fixed multipliers of the mixers (odd 64-bit numbers).
K1, K2, K3, K4 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
BIN_BITS = 7
BINS = 1 << BIN_BITS
CACHED_WORDS = 300_000
#: 64-bit words of a bitmap of hashes.
MAP_WORDS = 8


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * K4
    x = x ^ (x >> np.uint64(29))
    x = x * K2
    return x ^ (x >> np.uint64(32))


class Words(dict):
    """The 64-bit hash of each word, cached."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 40:
            self[word] = h
        return h


def word_hashes(text: str | None, cache: Words, fold: bool) -> np.ndarray:
    """The hashes of a text's words, split at space and 09 to 0D; A-Z in lower case if ``fold``."""
    data = (text or "").encode()
    own = (data.translate(LOWER) if fold else data).split()
    if len(cache) > CACHED_WORDS:
        cache.clear()
    return np.fromiter(map(cache.__getitem__, own), np.uint64, len(own))


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """The 64-bit hashes of all runs of k words, in order."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = mix(out + words[i : i + n] * K1)
    return out


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """The sorted distinct hashes of k-word shingles; of fewer words, the whole sequence is one."""
    if 0 < len(words) < k:
        return grams(words, len(words)) ^ np.uint64(len(words))
    return np.unique(grams(words, k))


class Sketch:
    """One-permutation hashing into 128 bins, with optimal densification, and banded keys.

    The leading bits of a shingle's hash are its bin, the least hash of a bin
    its value. An empty bin takes the value of the first full bin in a random
    order of its own, the same for all sets.
    """

    def __init__(self, bands: int, rows: int, seed: int = 11):
        self.bands, self.rows = bands, rows
        self.edges = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BIN_BITS)
        rng = np.random.default_rng(seed)
        self.orders = np.argsort(rng.random((BINS, BINS)), axis=1)
        self.salts = mix(np.arange(1, bands + 1, dtype=np.uint64) * K3)

    def bins(self, shingles: np.ndarray) -> np.ndarray:
        """The densified value of each bin of a non-empty sorted set."""
        first = np.searchsorted(shingles, self.edges)
        full = np.append(first[1:], len(shingles)) > first
        if not full.all():
            empty = np.flatnonzero(~full)
            orders = self.orders[empty]
            donor = orders[np.arange(len(empty)), full[orders].argmax(axis=1)]
            first[empty] = first[donor]
        return shingles[first]

    def keys(self, bins: np.ndarray, setting: int = 0) -> np.ndarray:
        """The bucket key of each band, for rows of bins; the band and the setting are part of the key."""
        own = bins[:, : self.bands * self.rows].reshape(len(bins), self.bands, self.rows)
        out = np.broadcast_to(mix(self.salts + np.uint64(setting)), own.shape[:2]).copy()
        for r in range(self.rows):
            out = mix(out + own[:, :, r] * K1)
        return out.view(np.int64)


def set_id(shingles: np.ndarray) -> bytes:
    """A 128-bit name of a set."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


def without(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The elements of a sorted set that another lacks."""
    if not len(b):
        return a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return a[b[at] != a]


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """A bitmap of 64 * MAP_WORDS bits with one bit set for each hash."""
    bits = np.zeros(64 * MAP_WORDS, np.uint8)
    bits[(hashes % np.uint64(64 * MAP_WORDS)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)
