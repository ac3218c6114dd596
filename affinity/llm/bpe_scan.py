"""Byte-level BPE on the workers: boundary scan, cached pair merging, decoding.

Needs numpy and the standard library only, so that it can be sent by value.
"""

from __future__ import annotations

import heapq
import sys
import types

import numpy as np

# Code-point classes.
OTHER, LETTER, NUMBER, SPACE = range(4)
# Symbols of the scan: classes, with what follows already looked up.
S_OTHER, S_LETTER, S_NUMBER, S_BLANK, S_LAST_20, S_LAST, S_SHORT, S_LONG, S_END = range(9)
# States: what the piece so far is; X1 and X2 await the last letters of a contraction.
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_BLANKS, AFTER_20, X1, X2 = range(8)
N_STATES = 8
BLOCK = 256
#: Pieces of more bytes aren't cached; the cache is emptied at so many pieces.
CACHED_BYTES, CACHED_PIECES = 48, 500_000
#: Pieces of at most so many bytes are merged by scanning; a rank above all others.
SCANNED_BYTES, NO_RANK = 40, 1 << 40


def transitions() -> tuple[np.ndarray, np.ndarray]:
    """The next state, and whether a piece starts, by symbol * N_STATES + state."""
    to = np.zeros((9, N_STATES), np.uint8)
    new = np.ones((9, N_STATES), bool)

    def joins(symbol: int, states: tuple, state: int) -> None:
        to[symbol, list(states)] = state
        new[symbol, list(states)] = False

    for symbol, state in ((S_LETTER, IN_LETTERS), (S_NUMBER, IN_NUMBERS), (S_OTHER, IN_OTHERS)):
        to[symbol] = state
        joins(symbol, (state, AFTER_20), state)
    joins(S_LETTER, (X1,), START)
    joins(S_LETTER, (X2,), X1)
    # An apostrophe inside a run, or after a space, belongs to that piece; else it opens a contraction.
    for symbol, state in ((S_SHORT, X1), (S_LONG, X2)):
        to[symbol] = state
        joins(symbol, (IN_OTHERS, AFTER_20), IN_OTHERS)
    # Blanks that more blanks or the end follow; then the last of a run before something else.
    to[S_BLANK] = IN_BLANKS
    joins(S_BLANK, (IN_BLANKS,), IN_BLANKS)
    to[S_LAST_20] = AFTER_20
    to[S_LAST] = START
    to[S_END] = START
    return to.ravel(), new.ravel()


TO, NEW = transitions()


def symbols(points: np.ndarray, ends: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The scan's symbols of code points; ``ends`` are the positions of the separators after each text."""
    n = len(points)
    kind = classes[points]
    kind[ends] = OTHER
    following = np.empty(n, np.uint8)
    following[:-1] = kind[1:]
    following[-1:] = OTHER
    at_end = np.zeros(n, bool)
    at_end[ends - 1] = True  # for an empty text this is another separator; it is overwritten below
    out = np.array([S_OTHER, S_LETTER, S_NUMBER, S_BLANK], np.uint8)[kind]
    last = (kind == SPACE) & (following != SPACE) & ~at_end
    out[last] = np.where(points[last] == 0x20, S_LAST_20, S_LAST)
    at = np.flatnonzero(points == 0x27)
    one, two = (np.append(points, [0, 0])[at + k] for k in (1, 2))
    pair = lambda a, b: (one == ord(a)) & (two == ord(b))
    out[at[pair("r", "e") | pair("v", "e") | pair("l", "l")]] = S_LONG
    out[at[np.isin(one, [ord(c) for c in "stmd"])]] = S_SHORT
    out[ends] = S_END
    return out


def starts(symbol: np.ndarray) -> np.ndarray:
    """Where pieces start, by composing the symbols' transition functions.

    Composition is associative: each block of symbols becomes one function of
    the state before it, for all blocks at once; then the blocks' functions are
    applied in order, and a second pass over all blocks has its first state.
    """
    n = len(symbol)
    rows = -(-n // BLOCK)
    padded = np.full(rows * BLOCK, S_END, np.uint8)
    padded[:n] = symbol
    columns = np.ascontiguousarray(padded.reshape(rows, BLOCK).T).astype(np.intp) * N_STATES
    effect = np.tile(np.arange(N_STATES, dtype=np.uint8), (rows, 1))
    for column in columns:
        effect = TO.take(column[:, None] + effect)
    state, first = START, np.empty(rows, np.uint8)
    for r, row in enumerate(effect.tolist()):
        first[r] = state
        state = row[state]
    new, state = np.empty((BLOCK, rows), bool), first
    for k, column in enumerate(columns):
        at = column + state
        new[k] = NEW.take(at)
        state = TO.take(at)
    return np.flatnonzero(new.T.ravel()[:n])


class Pieces(dict):
    """Cached pair merging: the bytes of a piece to its ids, as little-endian 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: bytes) -> bytes:
        ids = np.array(merged(piece, self.ranks), "<u4").tobytes()
        if len(piece) <= CACHED_BYTES:
            self[piece] = ids
        return ids


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece: the adjacent pair of lowest rank is merged first, the leftmost of equals."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    if n <= SCANNED_BYTES:
        return merged_short(piece, ranks)
    end = list(range(1, n + 1))  # of the part that starts here
    before = list(range(-1, n - 1))  # start of the part before
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        gone = end[i]
        alive[gone] = False
        end[i] = stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (p := before[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


def merged_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for a short piece: scanning the pairs for the lowest costs less than a heap."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    rank, none = ranks.get, NO_RANK
    pairs = [rank(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while pairs and (least := min(pairs)) < none:
        i = pairs.index(least)
        parts[i] += parts.pop(i + 1)
        del pairs[i]
        if i < len(pairs):
            pairs[i] = rank(parts[i] + parts[i + 1], none)
        if i:
            pairs[i - 1] = rank(parts[i - 1] + parts[i], none)
    return [ranks[x] for x in parts]


def in_process(key: str, make):
    """What ``make`` returns, kept for later tasks of the same worker process."""
    kept = sys.modules.setdefault("affinity_kept", types.ModuleType("affinity_kept")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


class Codec:
    """Encodes and decodes texts by a table of ranks and the classes of all code points."""

    def __init__(self, ranks: dict[bytes, int], classes: np.ndarray):
        self.classes = classes
        self.cache = Pieces(ranks)
        self.token = {i: piece for piece, i in ranks.items()}

    def slices(self, texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The UTF-8 of texts, each with a separator; byte offsets of their pieces and separators; first piece by text."""
        joined = "\0".join(texts) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        start = starts(symbols(points, ends, self.classes))
        width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        offset = np.concatenate([[0], np.cumsum(width)])[start]
        first = np.searchsorted(start, np.concatenate([[0], ends[:-1] + 1]))
        return joined.encode(), offset, first

    def encode(self, texts: list[str]) -> list[tuple[bytes, np.ndarray]]:
        """For each text its ids (little-endian 32-bit) and the byte offsets where its pieces start."""
        if not texts:
            return []
        data, offset, first = self.slices(texts)
        at = offset.tolist()
        out = []
        for k, a in enumerate(first.tolist()):
            b = (int(first[k + 1]) if k + 1 < len(first) else len(at)) - 1  # the last is the separator
            get = self.cache.__getitem__
            ids = b"".join(map(get, map(data.__getitem__, map(slice, at[a:b], at[a + 1 : b + 1]))))
            out.append((ids, offset[a:b] - offset[a]))
            if len(self.cache) > CACHED_PIECES:
                self.cache.clear()
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes that little-endian 32-bit ids stand for."""
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))
