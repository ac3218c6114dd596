"""Anchored segments of symbol sequences, on the workers; numpy only.

A window is ``k`` consecutive symbols of one text. Its anchor is the run of
``g`` symbols in it with the least hash, the leftmost of equals. Consecutive
windows with the same anchor are one segment. Equal windows have equal anchors
at the same place in them, whatever stands around, so repeats are found among
the segments of one anchor; there are far fewer segments than windows. Equal
segments that follow one another, as in periodic text, are one row.
"""

from __future__ import annotations

import numpy as np

from affinity.llm.signatures import K1, K2, K3, Words, mix, word_hashes

POSITION_BITS = 28
LOW = np.uint64((1 << POSITION_BITS) - 1)
# An odd multiplier and its inverse modulo 2**64, for hashes of ranges.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class WordSymbols:
    """Words as 64-bit hashes; the windows of the contract are 13 words."""

    k, g = 13, 4

    def __init__(self):
        self.cache = Words()

    def read(self, text: str | None) -> np.ndarray:
        """The symbols of a text."""
        return word_hashes(text, self.cache, False)

    def values(self, symbols: np.ndarray) -> np.ndarray:
        """A well-mixed 64-bit value of each symbol."""
        return symbols

    def gram_hashes(self, symbols: np.ndarray) -> np.ndarray:
        """The hash of each run of g symbols."""
        n = len(symbols) - self.g + 1
        return mix(symbols[:n] * K1 + symbols[1 : n + 1] * K2 + symbols[2 : n + 2] * K3 + mix(symbols[3 : n + 3]))


class ByteSymbols:
    """UTF-8 bytes; the windows of the contract are 100 bytes."""

    k, g = 100, 24

    def __init__(self):
        self.table = mix(np.arange(1, 257, dtype=np.uint64) * K3)

    def read(self, text: str | None) -> np.ndarray:
        """The symbols of a text."""
        return np.frombuffer((text or "").encode(), np.uint8)

    def values(self, symbols: np.ndarray) -> np.ndarray:
        """A well-mixed 64-bit value of each symbol."""
        return self.table[symbols]

    def gram_hashes(self, symbols: np.ndarray) -> np.ndarray:
        """The hash of each run of g symbols."""
        eights = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(symbols, 8)).view(np.uint64).ravel()
        n = len(symbols) - self.g + 1
        return mix(eights[:n] * K1 + eights[8 : n + 8] * K2 + eights[16 : n + 16] * K3)


def least(values: np.ndarray, w: int) -> np.ndarray:
    """The least of every w consecutive values, by doubling."""
    size = 1
    while size * 2 <= w:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (w - size)], values[w - size :]) if w > size else values


def cut(symbols: np.ndarray, k: int, most: int = 1 << 20) -> list[tuple[int, np.ndarray]]:
    """A text in parts of so many windows at most, each with its place; the parts overlap so that no window is lost."""
    return [(at, symbols[at : at + most + k - 1]) for at in range(0, max(1, len(symbols) - k + 1), most)]


class Segments:
    """The segments of several texts: for each its text, anchor, start, windows, anchor offset, content hash and how often it follows itself.

    If not ``whole``, only the anchors are there, each segment's own.
    """

    def __init__(self, texts: list[np.ndarray], kind, whole: bool = True):
        k, g = kind.k, kind.g
        sizes = np.array([len(t) for t in texts], np.int64)
        begin = np.concatenate([[0], np.cumsum(sizes)])
        symbols = np.concatenate(texts) if texts else np.zeros(0, np.uint8)
        n = len(symbols) - k + 1
        empty = np.zeros(0, np.int64)
        self.text = self.start = self.n = self.offset = self.times = empty
        self.anchor = self.content = empty.astype(np.uint64)
        if n <= 0:
            return
        owner = np.repeat(np.arange(len(texts)), sizes)
        inside = owner[:n] == owner[k - 1 :]
        if len(symbols) > int(LOW):
            raise ValueError("parts of texts of more than 2**28 symbols in all")
        hashes = kind.gram_hashes(symbols)
        keys = (hashes & ~LOW) | np.arange(len(hashes), dtype=np.uint64)
        at = (least(keys, k - g + 1) & LOW).astype(np.int64)[:n]
        new = np.ones(n, bool)
        new[1:] = (at[1:] != at[:-1]) | ~inside[:-1] | (owner[1:n] != owner[: n - 1])
        first = np.flatnonzero(new & inside)
        ends = np.append(np.flatnonzero(new | ~inside), n)
        if not whole:
            self.anchor = hashes[at[first]]
            return
        count = ends[np.searchsorted(ends, first, "right")] - first
        # Hashes of ranges: differences of prefix sums of value * BASE**place, scaled back to place 0.
        places = np.ones(len(symbols) + 1, np.uint64)
        places[1:] = BASE
        inverse = places.copy()
        inverse[1:] = INVERSE
        np.multiply.accumulate(places, out=places)
        np.multiply.accumulate(inverse, out=inverse)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(kind.values(symbols) * places[:-1], dtype=np.uint64)])
        content = mix((sums[first + count + k - 1] - sums[first]) * inverse[first] + count.astype(np.uint64) * K2 + (at[first] - first).astype(np.uint64))
        # Runs of equal segments, each right behind the one before it.
        run = np.ones(len(first), bool)
        run[1:] = (content[1:] != content[:-1]) | (owner[first[1:]] != owner[first[:-1]]) | (first[1:] != first[:-1] + count[:-1]) | (count[1:] != count[:-1])
        head = np.flatnonzero(run)
        self.times = np.diff(np.append(head, len(first)))
        first = first[head]
        self.text = owner[first]
        self.start = first - begin[self.text]
        self.n, self.offset = count[head], at[first] - first
        self.anchor, self.content = hashes[at[first]], content[head]


def earliest(group: np.ndarray, key_a: np.ndarray, key_b: np.ndarray) -> np.ndarray:
    """For each row the index of the row with the least (key_a, key_b) in its group."""
    order = np.lexsort((key_b, key_a, group))
    own = group[order]
    head = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    out = np.empty(len(group), np.int64)
    out[order] = np.repeat(order[head], np.diff(np.append(head, len(group))))
    return out


def runs_of(best: np.ndarray, where: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring places of one segment with the same best: segment, first place, last place, best.

    The inputs are in the order of (segment, place).
    """
    if not len(best):
        return best, best, best, best
    new = np.append(True, (where[1:] != where[:-1]) | (best[1:] != best[:-1]) | (place[1:] != place[:-1] + 1))
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(best)) - 1
    return where[head], place[head], place[tail], best[head]


def covered(n: int, starts: list[int], ends: list[int]) -> tuple[np.ndarray, int]:
    """Which of n symbols lie in ranges, and how many maximal runs these make; ranges are clipped."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, np.minimum(np.array(starts, np.int64), n), 1)
    np.add.at(delta, np.minimum(np.array(ends, np.int64), n), -1)
    mask = np.cumsum(delta[:n]) > 0
    return mask, int((np.diff(mask.astype(np.int8), prepend=0) == 1).sum())
