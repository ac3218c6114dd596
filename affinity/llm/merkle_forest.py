"""Sparse forests of hash trees whose widths are known, on the workers.

A sequence of ``size`` leaves has at each level ``ceil(size / arity ** level)``
nodes; every ``arity`` consecutive ones make one of the next level (the last run
may be shorter, even one node), until one is left. A fragment is a set of nodes
keyed by level and index. Fragments of disjoint leaves are merged by uniting
them and replacing each complete run of siblings by its parent, as long as there
is one. The result doesn't depend on the order or grouping of merges, and a
fragment over consecutive leaves keeps at most ``2 * (arity - 1)`` nodes a level.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from hashlib import sha256

Node = tuple[int, int, str]
#: Siblings left and right of a node on its way up, one pair a level, their digests concatenated.
Path = list[tuple[str, str]]


def digest(text: str) -> str:
    """The lowercase hexadecimal SHA-256 of a text."""
    return sha256(text.encode()).hexdigest()


def resolve(nodes: Iterable[Node], size: int, arity: int) -> tuple[list[Node], dict[tuple[int, int], tuple[str, str]]]:
    """The nodes left when all complete runs are replaced by their parents, and the siblings of each node replaced."""
    levels: dict[int, dict[int, str]] = defaultdict(dict)
    for level, index, value in nodes:
        levels[level][index] = value
    left: list[Node] = []
    siblings: dict[tuple[int, int], tuple[str, str]] = {}
    level, width = 0, size
    while levels:
        here = levels.pop(level, {})
        for parent in sorted({i // arity for i in here}):
            run = range(parent * arity, min(width, (parent + 1) * arity))
            if width > 1 and all(i in here for i in run):
                values = [here[i] for i in run]
                levels[level + 1][parent] = digest("".join(values))
                for k, i in enumerate(run):
                    siblings[level, i] = "".join(values[:k]), "".join(values[k + 1 :])
            else:
                left += [(level, i, here[i]) for i in run if i in here]
        level, width = level + 1, -(-width // arity)
    return left, siblings


def climb(level: int, index: int, siblings: dict, arity: int) -> tuple[int, int, Path]:
    """The node of what is left above a node, and the path up to it."""
    path: Path = []
    while (level, index) in siblings:
        path.append(siblings[level, index])
        level, index = level + 1, index // arity
    return level, index, path


def fold(value: str, path: Path) -> str:
    """The digest at the end of a path from a node with this digest."""
    for before, after in path:
        value = digest(before + value + after)
    return value


def proof(path: Path) -> str:
    """The digest of a path's siblings, level by level, left to right."""
    return digest("".join(before + after for before, after in path))
