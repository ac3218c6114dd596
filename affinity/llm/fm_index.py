"""A compressed FM-index of symbol sequences, on the workers; numpy only.

The Burrows-Wheeler transform is held in a wavelet tree (one bit vector for each
bit of a symbol's number, with rank samples), so rank takes one step for each
bit. All queries are stepped together.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with rank: words of 64 bits, 16 bits for each word and 32 for every eight of them."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 512) * 512, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.uint32).reshape(-1, 8)
        self.blocks = np.concatenate([[0], np.cumsum(counts.sum(axis=1))[:-1]]).astype(np.uint32)
        self.inside = (np.cumsum(counts, axis=1) - counts).astype(np.uint16).ravel()

    def ones(self, at: np.ndarray) -> np.ndarray:
        """How many ones lie before each place."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.blocks[word >> 3].astype(np.int64) + self.inside[word] + np.bitwise_count(self.words[word] & mask)


class WaveletTree:
    """Rank of symbols: level by level, from the leading bit, zeros are moved before ones."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels, self.zeros, self.bits = [], [], bits
        for b in reversed(range(bits)):
            bit = ((symbols >> b) & 1).astype(np.uint8)
            self.levels.append(Bits(bit))
            self.zeros.append(len(bit) - int(bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many of a symbol lie before each place, counted from where the symbol's run starts on the last level."""
        for level, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            ones = bits.ones(at)
            one = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            at = np.where(one, zeros + ones, at - ones)
        return at


class FMIndex:
    """Index of sequences: the wavelet tree of their Burrows-Wheeler transform, and each window's least label.

    ``symbols`` are numbers from 1 on; each sequence ends with a 0. Suffixes are
    ordered by their first ``depth`` symbols, which is all that backward search
    over ``depth`` symbols needs. The suffix array isn't kept: a bit vector marks
    where suffixes differ in these symbols, and of each group only the least of
    its ``labels`` (one for each symbol) is kept; another marks where they differ
    in all of these symbols but the last.
    """

    def __init__(self, symbols: np.ndarray, depth: int, labels: np.ndarray):
        self.depth = depth
        suffixes, new, shorter = self.sort(symbols, depth)
        last = symbols[suffixes - 1]  # of suffix 0 it is the final 0
        self.bits = max(1, int(symbols.max(initial=0)).bit_length())
        self.tree = WaveletTree(last, self.bits)
        # Where each symbol's run starts on the last level, and where its suffixes start.
        self.size = len(symbols)
        counts = np.bincount(symbols, minlength=1 << self.bits)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        every = np.arange(1 << self.bits)
        self.origin = self.tree.rank(every, np.zeros(len(every), np.int64))
        self.heads, self.shorter = Bits(new.astype(np.uint8)), Bits(shorter.astype(np.uint8))
        self.bounds = np.append(np.flatnonzero(shorter), len(symbols)).astype(np.int32)
        self.least = np.minimum.reduceat(labels[suffixes], np.flatnonzero(new))

    @staticmethod
    def sort(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Suffixes by their first ``depth`` symbols, by doubling, where these change, and where all but the last of these do.

        Suffixes are compared past a sequence's end too.
        """
        rank = symbols.astype(np.int64)
        order, size, before = np.argsort(rank), 1, np.zeros(len(rank), np.int64)
        while size < depth:
            shift = min(size, depth - 1 - size) or 1
            before = rank
            after = np.zeros(len(rank), np.int64)
            after[:-shift] = rank[shift:] + 1
            key = rank * (int(after.max(initial=0)) + 1) + after
            order = np.argsort(key)
            own = key[order]
            rank = np.empty(len(key), np.int64)
            rank[order] = np.cumsum(np.append(0, own[1:] != own[:-1]))
            size += shift
        return order, np.append(True, np.diff(rank[order]) != 0), np.append(True, np.diff(before[order]) != 0)

    def least_label(self, low: np.ndarray) -> np.ndarray:
        """The least label of the suffixes that agree with the one at each place in ``depth`` symbols."""
        return self.least[self.heads.ones(low + 1) - 1]

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the suffixes that start with the symbol and go on as those from low to high."""
        start = self.first[symbol]
        return start + self.tree.rank(symbol, low) - self.origin[symbol], start + self.tree.rank(symbol, high) - self.origin[symbol]

    def search(self, symbols: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics at the ends of queries.

        For each end: how many symbols before it (up to ``length``) match, and
        the suffixes, from low to high, that start with them.
        """
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.size)
        found = np.zeros(len(ends), np.int64)
        live = np.arange(len(ends))
        for k in range(1, length + 1):
            live = live[ends[live] >= k]
            symbol = symbols[ends[live] - k]
            a, b = self.step(symbol, low[live], high[live])
            go = (b > a) & (symbol > 0)
            live = live[go]
            low[live], high[live] = a[go], b[go]
            found[live] = k
        return found, low, high

    def stream(self, symbols: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Matching statistics along sequences of windows: for each the first suffix that starts with it, or -1.

        Window w of a sequence are the ``depth`` symbols from ``begin`` + w on.
        Windows are taken from the last on. The suffixes that start with one of them
        lie among those that agree with it in all but its last symbol; these are a
        group of their own, and one step in front of the group gives the window
        before. Only a window behind which none was found is searched whole.
        """
        out = np.full(int(count.sum()), -1)
        last = np.cumsum(count) - 1
        live, low, known = np.arange(len(begin)), np.zeros(len(begin), np.int64), np.zeros(len(begin), bool)
        for j in range(int(count.max(initial=0))):
            live = live[count[live] > j]
            at = begin[live] + count[live] - 1 - j
            a, b = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
            whole, step = np.flatnonzero(~known[live]), np.flatnonzero(known[live])
            found, x, y = self.search(symbols, at[whole] + self.depth, self.depth)
            a[whole], b[whole] = x, np.where(found == self.depth, y, x)
            group = self.shorter.ones(low[live[step]] + 1) - 1
            symbol = symbols[at[step]]
            x, y = self.step(symbol, self.bounds[group], self.bounds[group + 1])
            a[step], b[step] = x, np.where(symbol > 0, y, x)
            there = b > a
            known[live] = there
            low[live[there]] = a[there]
            out[last[live[there]] - j] = a[there]
        return out
