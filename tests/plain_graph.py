"""Sequential versions of graph algorithms that hold a whole graph, to compare with."""

import itertools
from collections import defaultdict


def modularity(edges: list[tuple], part: dict) -> float:
    """The modularity of a partition of weighted edges."""
    total = sum(w for *_, w in edges)
    inside, ends = defaultdict(float), defaultdict(float)
    for a, b, w in edges:
        ends[part[a]] += w
        ends[part[b]] += w
        inside[part[a]] += w * (part[a] == part[b])
    return sum(inside[c] / total - (ends[c] / (2 * total)) ** 2 for c in ends) if total else 0.0


def louvain(edges: list[tuple]) -> dict:
    """Communities by greedy modularity with levels; nodes are visited in sorted order, so the result is fixed."""
    place = {v: v for a, b, _ in edges for v in (a, b)}
    level = [(a, b, w) for a, b, w in edges]
    total = sum(w for *_, w in edges) or 1.0
    while True:
        near, degree = defaultdict(lambda: defaultdict(float)), defaultdict(float)
        for a, b, w in level:
            degree[a] += w
            degree[b] += w
            if a != b:
                near[a][b] += w
                near[b][a] += w
        own = {v: v for v in degree}
        weight, moved, any_move = dict(degree), True, False
        while moved:
            moved = False
            for v in sorted(own):
                links = defaultdict(float)
                for u, w in near[v].items():
                    links[own[u]] += w
                old = own[v]
                weight[old] -= degree[v]
                gain = lambda c: links[c] - weight[c] * degree[v] / (2 * total)  # noqa: B023, E731
                best = min(sorted({old, *links}), key=lambda c: (-gain(c), c != old))  # noqa: B023
                if gain(best) <= gain(old) + 1e-12:
                    best = old
                weight[best] += degree[v]
                if best != old:
                    own[v], moved, any_move = best, True, True
        place = {v: own[c] for v, c in place.items()}
        if not any_move:
            return place
        folded = defaultdict(float)
        for a, b, w in level:
            folded[tuple(sorted((own[a], own[b])))] += w
        level = [(a, b, w) for (a, b), w in sorted(folded.items())]


def neighbours(edges, distance="weight"):
    """The neighbours of each node with their lengths."""
    out = defaultdict(list)
    for a, b, w in edges:
        d = 1.0 if distance is None else w if distance == "weight" else 1.0 / w
        out[a].append((b, d))
        out[b].append((a, d))
    return out


def betweenness(edges, distance="weight"):
    """Normalised betweenness from the lengths and numbers of all pairs' shortest paths."""
    near = neighbours(edges, distance)
    nodes = sorted(near)
    dist, count = {}, {}
    for s in nodes:
        far, left = {s: 0.0}, set(nodes)
        ways = defaultdict(int, {s: 1})
        while left & far.keys():
            v = min(left & far.keys(), key=lambda x: far[x])
            left.remove(v)
            for w, length in near[v]:
                if w not in far or far[v] + length < far[w]:
                    far[w], ways[w] = far[v] + length, ways[v]
                elif far[v] + length == far[w]:
                    ways[w] += ways[v]
        dist[s], count[s] = far, ways
    out = dict.fromkeys(nodes, 0.0)
    for s, t in itertools.combinations(nodes, 2):
        if t in dist[s]:
            for v in nodes:
                if v not in (s, t) and v in dist[s] and dist[s][v] + dist[v][t] == dist[s][t]:
                    out[v] += count[s][v] * count[v][t] / count[s][t]
    n = len(nodes)
    return {v: x * 2 / ((n - 1) * (n - 2)) for v, x in out.items()}
