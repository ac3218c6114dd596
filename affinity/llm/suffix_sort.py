"""Deep-shallow sorting of suffixes, on the workers; numpy and the standard library only.

Shallow: multikey quicksort down to a fixed depth. Every open group is split in
three by the byte that its middle suffix has at the group's depth: less, equal
and greater; the equal ones go one byte deeper. All groups are split at once.
Deep: the groups that are still tied have long common prefixes and are ordered
by blind tries, which look at one byte for each branching.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 32
ALPHABET_END = -1


class BlindTrie:
    """A compacted trie that keeps in each inner node only the depth at which its branches differ."""

    def __init__(self, data: bytes, ends: np.ndarray):
        self.data, self.ends = data, ends
        self.root: list | None = None

    def byte(self, start: int, depth: int) -> int:
        """The byte of a suffix at a depth, or what sorts before all bytes past its end."""
        at = start + depth
        return self.data[at] if at < self.ends[start] else ALPHABET_END

    def common(self, a: int, b: int, depth: int) -> int:
        """The length of the common prefix of two suffixes that agree up to ``depth``."""
        most = int(min(self.ends[a] - a, self.ends[b] - b))
        step = 16
        while depth < most:
            stop = min(depth + step, most)
            if self.data[a + depth : a + stop] == self.data[b + depth : b + stop]:
                depth, step = stop, step * 2
            elif stop - depth == 1:
                return depth
            else:
                step = max(1, (stop - depth) // 2)
        return most

    def insert(self, suffix: int) -> None:
        """Add a suffix: walk down blindly to a leaf, compare once, and branch where they differ."""
        if self.root is None:
            self.root = [None, [suffix]]
            return
        node = self.root
        while node[0] is not None:
            node = node[1].get(self.byte(suffix, node[0])) or next(iter(node[1].values()))
        other = node[1][0]
        depth = self.common(suffix, other, 0)
        mine, theirs = self.byte(suffix, depth), self.byte(other, depth)
        if mine == theirs:  # alike to the end of both
            node[1].append(suffix)
            return
        parent, key, node = None, None, self.root
        while node[0] is not None and node[0] < depth:
            parent, key = node, self.byte(suffix, node[0])
            node = node[1][key]
        if node[0] == depth:
            node[1][mine] = [None, [suffix]]
            return
        branch = [depth, {theirs: node, mine: [None, [suffix]]}]
        if parent is None:
            self.root = branch
        else:
            parent[1][key] = branch

    def sorted(self) -> list[int]:
        """All suffixes in order; those that are alike in the order of insertion."""
        out, stack = [], [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node[0] is None:
                out.extend(node[1])
            else:
                stack.extend(child for _, child in sorted(node[1].items(), reverse=True))
        return out


def multikey_quicksort(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, group: np.ndarray, most: int = SHALLOW) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Suffixes ``data[starts:ends]`` in order within each group by ``most`` bytes, and the places of those still tied."""
    order = np.argsort(group, kind="stable")
    own = group[order]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
    size, depth = np.diff(np.append(first, len(own))), np.zeros(len(first), np.int64)
    padded, tied = np.append(data, np.uint8(0)), []
    while True:
        deep = (depth >= most) & (size > 1)
        tied += zip(first[deep].tolist(), (first + size)[deep].tolist(), strict=True)
        go = (depth < most) & (size > 1)
        first, size, depth = first[go], size[go], depth[go]
        if not len(first):
            return order, sorted(tied)
        which = np.repeat(np.arange(len(first)), size)
        live = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + first[which]
        at = starts[order[live]] + depth[which]
        # Past its end, a suffix has what sorts before all bytes.
        byte = np.where(at < ends[order[live]], padded[np.minimum(at, len(data))].astype(np.int16), ALPHABET_END)
        pivot = byte[np.cumsum(size) - size + size // 2]
        key = which * 3 + 1 + np.sign(byte - pivot[which])
        own = np.argsort(key, kind="stable")
        order[live] = order[live][own]
        size = np.bincount(key, minlength=3 * len(first))
        start = np.repeat(first, 3) + (np.cumsum(size) - size) - np.repeat(np.cumsum(size.reshape(-1, 3).sum(axis=1)) - size.reshape(-1, 3).sum(axis=1), 3)
        depth = np.repeat(depth, 3)
        equal = np.tile([False, True, False], len(first))
        depth[equal] += 1
        ended = equal & (np.repeat(pivot, 3) == ALPHABET_END)
        size = np.where(ended, 0, size)  # alike to the end of all
        first = start


def sort_suffixes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The order of suffixes ``data[starts:ends]`` within each group (groups in the order of their number)."""
    order, tied = multikey_quicksort(data, starts, ends, group)
    if tied:
        lookup = dict(zip(starts.tolist(), ends.tolist(), strict=True))
        text = data.tobytes()
        for a, b in tied:
            members = order[a:b]
            trie = BlindTrie(text, lookup)
            by_start: dict[int, list[int]] = {}
            for m, s in zip(members.tolist(), starts[members].tolist(), strict=True):
                by_start.setdefault(s, []).append(m)
            for s in by_start:
                trie.insert(s)
            order[a:b] = [m for s in trie.sorted() for m in by_start[s]]
    return order


def common_prefixes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int) -> np.ndarray:
    """The common prefix length, up to ``most``, of each suffix with the one before it."""
    out = np.zeros(len(starts), np.int64)
    live = np.arange(1, len(starts))
    padded = np.append(data, np.uint8(0))
    for depth in range(most):
        a, b = starts[live - 1] + depth, starts[live] + depth
        same = (a < ends[live - 1]) & (b < ends[live])
        same &= padded[np.minimum(a, len(data))] == padded[np.minimum(b, len(data))]
        live = live[same]
        out[live] += 1
        if not len(live):
            break
    return out
