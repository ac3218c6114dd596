"""Hierarchical navigable small-world graphs over balls of vectors, on the workers; numpy only.

Vectors of one shard are dealt into balls: each goes to the nearest centre within
``JOIN`` of it, else it becomes a centre. Only centres are nodes of the graph, so
thousands of near copies are one node. When all are in, a ball's centre is the
mean of its members, which are kept in the order of their angle to it. For a
vector at angle ``a`` from the centre, members within ``limit - a`` are linked and
members beyond ``limit + a`` are not, whoever they are (angles obey the triangle
inequality); only those between are compared one by one, in double precision.

A search runs for many vectors in step: each keeps a beam of the best nodes seen
and expands the best ones not yet expanded, until none in the beam is left. Every
node seen within reach is a find, whether or not it stays in the beam; a beam with
none but finds is too narrow, and its vector is searched again with a wider one.
"""

from __future__ import annotations

import io
import math

import numpy as np

#: Links of a node (twice as many on the lowest layer), beam while building, nodes expanded in a step.
M, BUILD_BEAM, AT_ONCE = 16, 48, 4
#: Cosine from which a vector joins a centre's ball while building.
JOIN = 0.955
#: Slack of the angle bounds: far above the rounding of single precision.
SLACK = 2e-3
#: Vectors inserted or searched together, and bytes for what they have seen.
BATCH, SEEN_BYTES = 512, 32 << 20


def units(vectors: np.ndarray) -> np.ndarray:
    """The vectors at length one, single precision; scaled first, so that no square overflows."""
    wide = vectors.astype(np.float64)
    wide = wide / np.abs(wide).max(1, keepdims=True)
    return (wide / np.sqrt((wide * wide).sum(1, keepdims=True))).astype(np.float32)


def levels(ids: np.ndarray) -> np.ndarray:
    """The layer up to which each id is a node, geometric with factor 1 / M, from the id alone."""
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    draw = ((mixed >> np.uint64(12)).astype(np.float64) + 1) / 2.0**52
    return np.minimum(-np.log(draw) / math.log(M), 8).astype(np.int64)


def diverse(base: np.ndarray, near: np.ndarray, sims: np.ndarray, vectors: np.ndarray, most: int) -> np.ndarray:
    """For each base the neighbours to keep of candidates sorted from the nearest (-1: none).

    A candidate nearer to one kept before than to the base itself is reached through
    that one; such candidates only fill places left over.
    """
    n, c = near.shape
    own = vectors[np.maximum(near, 0)]
    between = np.einsum("bid,bjd->bij", own, own)
    keep, blocked = np.zeros((n, c), bool), near < 0
    count = np.zeros(n, np.int64)
    for k in range(c):
        take = ~blocked[:, k] & (count < most)
        keep[:, k] = take
        count += take
        blocked |= take[:, None] & (between[:, k, :] > sims)
    rank = np.where(keep, 0, np.where(near >= 0, 1, 2)) * c + np.arange(c)
    order = np.argsort(rank, 1)[:, :most]
    out = np.take_along_axis(near, order, 1)
    if out.shape[1] < most:
        out = np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)
    return out


class Graph:
    """The layers of a graph: on each, the links of its nodes."""

    def __init__(self, dim: int):
        self.vectors = np.zeros((0, dim), np.float32)
        self.level = np.zeros(0, np.int64)
        self.links: list[np.ndarray] = [np.zeros((0, 2 * M), np.int32)]
        self.entry = -1

    def __len__(self) -> int:
        return len(self.vectors)

    def scan(self, queries: np.ndarray, layer: int, start: np.ndarray, beam: int, reach: float | None = None, at_once: int = AT_ONCE) -> tuple:
        """Beams (nodes, sims; best first, -1 for none) on a layer from start nodes; with a reach also all finds (query, node, sim)."""
        links, n = self.links[layer], len(queries)
        beam = max(beam, start.shape[1])
        nodes = np.full((n, beam), -1, np.int32)
        sims = np.full((n, beam), -2, np.float32)
        done = np.ones((n, beam), bool)
        seen = np.zeros((n, len(self)), bool)
        found: list[tuple] = []

        def add(rows: np.ndarray, fresh: np.ndarray) -> None:
            """Take nodes (-1 for none) into the beams of rows."""
            valid = fresh >= 0
            r, c = np.nonzero(valid)
            picked = fresh[r, c]
            own = np.full(fresh.shape, -2, np.float32)
            own[r, c] = np.einsum("ij,ij->i", self.vectors[picked], queries[rows[r]])
            seen[rows[r], picked] = True
            if reach is not None:
                hit = own[r, c] >= reach
                if hit.any():
                    found.append((rows[r[hit]], picked[hit], own[r[hit], c[hit]]))
            all_sims = np.concatenate([sims[rows], own], 1)
            all_nodes = np.concatenate([nodes[rows], fresh], 1)
            all_done = np.concatenate([done[rows], ~valid], 1)
            order = np.argsort(-all_sims, 1)[:, :beam]
            sims[rows] = np.take_along_axis(all_sims, order, 1)
            nodes[rows] = np.take_along_axis(all_nodes, order, 1)
            done[rows] = np.take_along_axis(all_done, order, 1)

        active = np.arange(n)
        add(active, start.astype(np.int32))
        while True:
            active = active[~done[active].all(1)]
            if not len(active):
                break
            own = done[active]
            next_up = np.argsort(own, 1, kind="stable")[:, :at_once]  # beams are sorted: the best ones left
            left = ~np.take_along_axis(own, next_up, 1)
            chosen = np.where(left, np.take_along_axis(nodes[active], next_up, 1), -1)
            np.put_along_axis(own, next_up, True, 1)
            done[active] = own
            fresh = np.where(chosen[:, :, None] >= 0, links[np.maximum(chosen, 0)], -1).reshape(len(active), -1)
            fresh = np.sort(fresh, 1)  # each node once
            fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = -1
            fresh[seen[active[:, None], np.maximum(fresh, 0)]] = -1
            width = int((fresh >= 0).sum(1).max(initial=0))
            if width:
                add(active, np.sort(fresh, 1)[:, ::-1][:, :width].copy())
        if reach is None:
            return nodes, sims
        return nodes, sims, tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32))

    def descend(self, queries: np.ndarray, layer: int) -> np.ndarray:
        """The nearest node that the layers above this one lead to."""
        at = np.full((len(queries), 1), self.entry, np.int32)
        for upper in range(len(self.links) - 1, layer, -1):
            at = self.scan(queries, upper, at, 1, at_once=1)[0]
        return at

    def insert(self, vectors: np.ndarray, level: np.ndarray) -> None:
        """Add nodes; those of one call are candidates of each other too."""
        first, n = len(self), len(vectors)
        old_top = len(self.links) - 1
        starts = {}
        if first:
            at = np.full((n, 1), self.entry, np.int32)
            for layer in range(old_top, -1, -1):
                at, _ = self.scan(vectors, layer, at, BUILD_BEAM if (level >= layer).any() else 1)
                starts[layer] = at
                at = at[:, :1] if layer > int(level.max()) else at
        self.vectors = np.concatenate([self.vectors, vectors])
        self.level = np.concatenate([self.level, level])
        for layer in range(int(level.max()) + 1):
            if layer == len(self.links):
                self.links.append(np.full((first, M), -1, np.int32))
        for layer, links in enumerate(self.links):
            self.links[layer] = np.concatenate([links, np.full((n, links.shape[1]), -1, np.int32)])
        among = vectors @ vectors.T
        for layer in range(int(level.max()) + 1):
            rows = np.flatnonzero(level >= layer)
            peers = among[np.ix_(rows, rows)]
            np.fill_diagonal(peers, -2)
            keep = min(BUILD_BEAM, len(rows))
            best = np.argpartition(-peers, keep - 1, 1)[:, :keep]
            near = np.where(np.take_along_axis(peers, best, 1) > -2, rows[best] + first, -1)
            if layer in starts:
                near = np.concatenate([starts[layer][rows], near], 1)
            self.join(layer, rows + first, near.astype(np.int32), M)
            # And back: each node linked to keeps the best of its old links and the new ones.
            own = self.links[layer][rows + first]
            r, c = np.nonzero(own >= 0)
            target, source = own[r, c], rows[r] + first
            order = np.argsort(target, kind="stable")
            target, source = target[order], source[order]
            heads = np.flatnonzero(np.append(True, target[1:] != target[:-1])) if len(target) else np.zeros(0, np.int64)
            counts = np.diff(np.append(heads, len(target)))
            place = np.arange(len(target)) - np.repeat(heads, counts)
            few = place < 4 * M
            back = np.full((len(heads), min(int(counts.max(initial=0)), 4 * M)), -1, np.int32)
            back[np.repeat(np.arange(len(heads)), counts)[few], place[few]] = source[few]
            for a in range(0, len(heads), BATCH):
                some = target[heads[a : a + BATCH]]
                self.join(layer, some, np.concatenate([self.links[layer][some], back[a : a + BATCH]], 1), self.links[layer].shape[1])
        if self.entry < 0 or int(level.max()) > old_top:
            self.entry = first + int(level.argmax())

    def join(self, layer: int, nodes: np.ndarray, near: np.ndarray, most: int) -> None:
        """Link nodes to the best of the candidates."""
        near = np.sort(near, 1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[near == nodes[:, None]] = -1
        sims = np.einsum("bcd,bd->bc", self.vectors[np.maximum(near, 0)], self.vectors[nodes])
        sims[near < 0] = -2
        order = np.argsort(-sims, 1)[:, : max(2 * M, BUILD_BEAM)]
        near, sims = np.take_along_axis(near, order, 1), np.take_along_axis(sims, order, 1)
        width = max(1, int((near >= 0).sum(1).max(initial=0)))
        kept = diverse(nodes, near[:, :width], sims[:, :width], self.vectors, most)
        self.links[layer][nodes, :most] = kept
        self.links[layer][nodes, most:] = -1


class Index:
    """A shard's balls and the graph over their centres."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, vectors: np.ndarray):
        unit = units(vectors)
        self.graph = Graph(vectors.shape[1])
        ball = np.zeros(len(ids), np.int64)
        leaders: list[np.ndarray] = []
        a = 0
        while a < len(ids):
            # The first batches are small, so that later ones find a graph.
            b = min(len(ids), a + max(64, min(BATCH, a, SEEN_BYTES // max(1, len(self.graph)))))
            own = unit[a:b]
            home = np.full(b - a, -1, np.int64)
            if len(self.graph):
                nodes, sims = self.graph.scan(own, 0, self.graph.descend(own, 0), BUILD_BEAM // 2)
                home = np.where(sims[:, 0] >= JOIN, nodes[:, 0], -1)
            new = np.flatnonzero(home < 0)
            close = np.triu(own[new] @ own[new].T >= JOIN, 1)
            leads = np.ones(len(new), bool)
            to = np.arange(len(new))
            for i in np.flatnonzero(close.any(1)):
                if leads[i]:
                    mine = close[i] & leads & (to == np.arange(len(new)))
                    leads[mine] = False
                    to[mine] = i
            number = len(self.graph) + np.cumsum(leads) - 1
            home[new] = number[to]
            ball[a:b] = home
            if leads.any():
                chosen = a + new[leads]
                leaders.append(chosen)
                self.graph.insert(unit[chosen], levels(ids[chosen]))
            a = b
        self.finish(ids, weights, vectors, unit, ball)

    def finish(self, ids: np.ndarray, weights: np.ndarray, vectors: np.ndarray, unit: np.ndarray, ball: np.ndarray) -> None:
        """Centres become means; members are sorted by ball and angle."""
        count = len(self.graph)
        sums = np.zeros((count, unit.shape[1]))
        np.add.at(sums, ball, unit.astype(np.float64))
        self.graph.vectors = units(sums)
        angle = np.arccos(np.clip(np.einsum("ij,ij->i", unit, self.graph.vectors[ball]), -1, 1)).astype(np.float64)
        order = np.lexsort((angle, ball))
        self.ids, self.vectors, self.angle = ids[order], vectors[order], angle[order]
        self.norms = norms(self.vectors)
        self.begin = np.searchsorted(ball[order], np.arange(count + 1))
        self.weight = np.append(0, np.cumsum(weights[order]))
        self.radius = self.angle[self.begin[1:] - 1]

    def dump(self) -> bytes:
        """The index as bytes."""
        out = io.BytesIO()
        graph = self.graph
        arrays = {f"links{k}": x for k, x in enumerate(graph.links)}
        np.savez(out, centres=graph.vectors, level=graph.level, entry=graph.entry, ids=self.ids, vectors=self.vectors, angle=self.angle, norms=self.norms, begin=self.begin, weight=self.weight, radius=self.radius, **arrays)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Index:
        """The index of ``dump``."""
        z = np.load(io.BytesIO(data))
        self = cls.__new__(cls)
        self.graph = Graph(z["centres"].shape[1])
        self.graph.vectors, self.graph.level, self.graph.entry = z["centres"], z["level"], int(z["entry"])
        self.graph.links = [z[f"links{k}"] for k in range(sum(x.startswith("links") for x in z.files))]
        for name in ("ids", "vectors", "angle", "norms", "begin", "weight", "radius"):
            setattr(self, name, z[name])
        return self

    def balls(self, unit: np.ndarray, limit: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The pairs (query, ball) whose ball may hold a vector within the limit angle, as far as the beams find them."""
        most = limit + float(self.radius.max(initial=0)) + SLACK
        reach = math.cos(min(math.pi, most))
        out_q, out_b = [], []
        todo, size = [np.arange(len(unit))], max(16, min(BATCH, SEEN_BYTES // max(1, len(self.graph))))
        while len(todo[0]):
            again = []
            for a in range(0, len(todo[0]), size):
                rows = todo[0][a : a + size]
                own = unit[rows]
                _, sims, (q, b, sim) = self.graph.scan(own, 0, self.graph.descend(own, 0), beam, reach)
                narrow = (sims[:, -1] >= reach) & (beam < len(self.graph))
                again.append(rows[narrow])
                good = ~narrow[q] & (np.arccos(np.clip(sim, -1, 1)) <= limit + self.radius[b] + SLACK)
                out_q.append(rows[q[good]])
                out_b.append(b[good].astype(np.int64))
            todo, beam = [np.concatenate(again)], 2 * beam
        return np.concatenate(out_q), np.concatenate(out_b)

    def home(self, ids: np.ndarray) -> np.ndarray:
        """The ball that holds each id, -1 if it isn't in this shard."""
        order = np.argsort(self.ids)
        at = np.minimum(np.searchsorted(self.ids, ids, sorter=order), len(order) - 1)
        place = order[at]
        return np.where(self.ids[place] == ids, np.searchsorted(self.begin, place, "right") - 1, -1)

    def audit(self, ids: np.ndarray, unit: np.ndarray, limit: float, beam: int, sample: int = 128) -> tuple[int, float]:
        """The beam with which no ball within the limit angle is missed by a sample of queries and of the shard's own centres; with its recall.

        The sample is of the ids with the least hashes; its truth is a comparison with every centre.
        """
        pick = np.argsort(levels_order(ids))[:sample]
        asked = np.concatenate([unit[pick], self.graph.vectors[np.argsort(levels_order(np.arange(len(self.graph))))[:sample]]])
        angles = np.arccos(np.clip(asked @ self.graph.vectors.T, -1, 1))
        truth = set(zip(*np.nonzero(angles <= limit + self.radius[None, :]), strict=True))
        while True:
            found = set(zip(*self.balls(asked, limit, beam), strict=True))
            recall = len(truth & found) / len(truth) if truth else 1.0
            if recall == 1.0 or beam >= len(self.graph):
                return beam, recall
            beam *= 2


def levels_order(ids: np.ndarray) -> np.ndarray:
    """A hash of ids, to order them without regard to their values."""
    mixed = ids.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    return mixed * np.uint64(0xD6E8FEB86659FD93)


def norms(vectors: np.ndarray) -> np.ndarray:
    """Lengths in double precision."""
    wide = vectors.astype(np.float64)
    return np.sqrt(np.einsum("ij,ij->i", wide, wide))
