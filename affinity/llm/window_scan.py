"""Finding windows of benchmark words in texts, on the workers; numpy only.

Words of a block of items have numbers from 1 on; other words and the borders of
texts are 0. A shingle of up to three words is one number, so every comparison
is exact.
"""

from __future__ import annotations

import hashlib

import numpy as np

WINDOW, SHINGLE = 13, 3
#: Bytes of UTF-8: capital letters to small ones; separators to blanks. Bytes over 7F belong to words.
TABLE = bytes(
    (b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20) for b in range(256)
)
CHUNK = 100_000


def words(text: str | None) -> list[bytes]:
    """The words of a text, A-Z in lower case."""
    return (text or "").encode().translate(TABLE).split()


class Block:
    """The windows of a block of items, and what is known of them.

    ``items`` are pairs (id, text). ``keys[s]`` are the sorted shingles of
    length s in the windows that have s words at least and no longer shingles.
    """

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        names = sorted({i for i, _ in items if i is not None}, key=str)
        self.names = [str(i) for i in names]
        rank = {i: k for k, i in enumerate(names)}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            size = min(WINDOW, len(ids))
            for k in range(len(ids) - size + 1 if ids else 0):
                found.setdefault(tuple(ids[k : k + size]), set()).update([rank[item]] if item is not None else [])
        self.base = len(self.vocabulary) + 1
        self.windows = sorted(found)
        self.items = [sorted(found[w]) for w in self.windows]
        parts: dict[int, set[int]] = {}
        for w in self.windows:
            parts.setdefault(min(SHINGLE, len(w)), set()).update(self.shingles(w))
        self.keys = {s: np.array(sorted(v), np.int64) for s, v in parts.items()}

    def shingles(self, window: tuple[int, ...]) -> list[int]:
        """The shingles of a window, in order."""
        s = min(SHINGLE, len(window))
        return [self.key(window[k : k + s]) for k in range(len(window) - s + 1)]

    def key(self, part: tuple[int, ...]) -> int:
        """A shingle as one number."""
        out = 0
        for x in part:
            out = out * self.base + x
        return out

    def index(self, counts: dict[tuple[int, int], int]) -> "Index":
        """The index by each window's rarest shingle; windows with a shingle that no text has can't occur."""
        anchors: dict[int, dict[int, list[tuple[int, int]]]] = {s: {} for s in self.keys}
        for w, window in enumerate(self.windows):
            s, parts = min(SHINGLE, len(window)), self.shingles(window)
            freq = [counts.get((s, p), 0) for p in parts]
            if min(freq):
                offset = min(range(len(parts)), key=lambda k: (freq[k], k))
                anchors[s].setdefault(parts[offset], []).append((w, offset))
        return Index(self, anchors)


class Reader:
    """The numbered words of texts, side by side with a zero after each."""

    def __init__(self, vocabulary: dict[bytes, int], base: int):
        self.get, self.base = vocabulary.get, base

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers; where each text starts, and the end of all."""
        get, ids, starts = self.get, [], [0]
        for t in texts:
            own = words(t)
            ids.append(np.fromiter(map(get, own, [0] * len(own)), np.int64, len(own)))
            ids.append(np.zeros(1, np.int64))
            starts.append(starts[-1] + len(own) + 1)
        return np.concatenate(ids) if ids else np.zeros(0, np.int64), np.array(starts)

    def find(self, ids: np.ndarray, s: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of shingles of s words that are among sorted keys, and which these are."""
        n = len(ids) - s + 1
        if n <= 0 or not len(keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = ids > 0
        ok = known[:n].copy()
        for k in range(1, s):
            ok &= known[k : n + k]
        at = np.flatnonzero(ok)
        own = np.zeros(len(at), np.int64)
        for k in range(s):
            own = own * self.base + ids[at + k]
        k = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        same = keys[k] == own
        return at[same], k[same]


class Index:
    """Prefix index: anchor shingle to the windows that have it as their rarest, with its place in them."""

    def __init__(self, block: Block, anchors: dict[int, dict[int, list[tuple[int, int]]]]):
        self.reader = (block.vocabulary, block.base)
        self.names, self.items = block.names, block.items
        self.size = np.array([len(w) for w in block.windows] or [0])
        self.matrix = np.zeros((max(1, len(block.windows)), WINDOW), np.int64)
        for k, w in enumerate(block.windows):
            self.matrix[k, : len(w)] = w
        self.by_size = {}
        for s, found in anchors.items():
            keys = sorted(found)
            pairs = [p for k in keys for p in found[k]]
            ends = np.cumsum([0] + [len(found[k]) for k in keys])
            self.by_size[s] = (np.array(keys, np.int64), ends, np.array([w for w, _ in pairs], np.int64), np.array([o for _, o in pairs], np.int64))

    def occurrences(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the texts; for every occurrence of a window its start and the window."""
        reader = Reader(*self.reader)
        ids, starts = reader.read(texts)
        begins, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s, (keys, ends, window, offset) in self.by_size.items():
            at, k = reader.find(ids, s, keys)
            for c in range(0, len(at), CHUNK):
                p, j = at[c : c + CHUNK], k[c : c + CHUNK]
                many = ends[j + 1] - ends[j]
                for d in range(int(many.max()) if len(many) else 0):
                    own = many > d
                    w = window[ends[j[own]] + d]
                    begin = p[own] - offset[ends[j[own]] + d]
                    fits = (begin >= 0) & (begin + self.size[w] <= len(ids))  # position and length
                    begin, w = begin[fits], w[fits]
                    cells = np.minimum(begin[:, None] + np.arange(WINDOW), len(ids) - 1)
                    want = self.matrix[w]
                    same = ((ids[cells] == want) | (want == 0)).all(axis=1)
                    begins.append(begin[same])
                    found.append(w[same])
        return starts, np.concatenate(begins), np.concatenate(found)

    def hits(self, texts: list[str | None]) -> list[tuple[int, list[int], list[int], list[int]]]:
        """For each text: number of words, starts and ends of its hit runs, and ranks of the items that hit it."""
        starts, begin, window = self.occurrences(texts)
        delta = np.zeros(starts[-1] + 1, np.int64)
        np.add.at(delta, begin, 1)
        np.add.at(delta, begin + self.size[window], -1)
        edge = np.diff((np.cumsum(delta) > 0).astype(np.int8), prepend=0)
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        run_text = np.searchsorted(starts, first, "right") - 1
        items: dict[int, set[int]] = {}
        pairs = np.unique(np.stack([np.searchsorted(starts, begin, "right") - 1, window]), axis=1)
        for t, w in pairs.T.tolist():
            items.setdefault(t, set()).update(self.items[w])
        out = [(int(b - a - 1), [], [], []) for a, b in zip(starts[:-1], starts[1:], strict=True)]
        for t, a, b in zip(run_text.tolist(), first.tolist(), last.tolist(), strict=True):
            out[t][1].append(a - int(starts[t]))
            out[t][2].append(b - int(starts[t]))
        for t, found in items.items():
            out[t][3].extend(sorted(found))
        return out


def joined_runs(a: list[int], b: list[int], c: list[int], d: list[int]) -> tuple[list[int], list[int]]:
    """The union of two sets of runs, each given by its starts and ends."""
    starts, ends = [], []
    for x, y in sorted([*zip(a, b, strict=True), *zip(c, d, strict=True)]):
        if ends and x <= ends[-1]:
            ends[-1] = max(ends[-1], y)
        else:
            starts.append(x)
            ends.append(y)
    return starts, ends


def digest(names: list[str]) -> str:
    """SHA-256 of strings, sorted and comma-joined."""
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
