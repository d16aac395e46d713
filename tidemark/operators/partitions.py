"""Clustering of one quarter's graph in memory: constant Potts communities, consensus, PageRank, assignment. NumPy only."""

from __future__ import annotations

from collections import deque
from heapq import heappop, heappush

import numpy as np


class Graph:
    """Neighbours and weights of each node as arrays: 20 bytes for each end of an edge. A node's neighbours are in the order they first came in."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, weight: np.ndarray, n: int):
        key = rows * np.int64(n) + cols
        order = np.argsort(key, kind="stable").astype(np.int32)
        key = key[order]
        new = np.diff(key, prepend=-1) > 0
        total = np.bincount(np.cumsum(new, dtype=np.int32) - 1, weights=weight[order])  # adds in the order given
        key, first = key[new], order[new]
        del order, new
        row = (key // max(n, 1)).astype(np.int32)
        key %= max(n, 1)
        order = np.lexsort((first, row))
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])
        self.to, self.weight = key.astype(np.int32)[order], total[order]

    def __len__(self) -> int:
        return len(self.begin) - 1

    def __getitem__(self, v: int) -> dict[int, float]:
        """The neighbours of v and their weights."""
        if not 0 <= v < len(self):
            raise IndexError(v)
        own = slice(self.begin[v], self.begin[v + 1])
        return dict(zip(self.to[own].tolist(), self.weight[own].tolist(), strict=True))

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self), dtype=np.int32), np.diff(self.begin))

    def weighted(self, weight: np.ndarray) -> Graph:
        out = object.__new__(Graph)
        out.begin, out.to, out.weight = self.begin, self.to, weight
        return out


def symmetric(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, n: int) -> Graph:
    """Neighbour weights of each node; both directions of an edge add up."""
    apart = src != dst
    src, dst, weight = src[apart], dst[apart], weight[apart]
    return Graph(np.stack([src, dst], axis=1).ravel(), np.stack([dst, src], axis=1).ravel(), np.repeat(weight, 2), n)


def potts_communities(near: Graph, resolution: float, seed: int = 42) -> np.ndarray:
    """Communities that raise weight inside minus resolution * size * size / 2: local moves, connected refinement, aggregation.

    Visits nodes in an order fixed by the seed; ties go to the smaller community. A community is split into its connected
    parts before it is aggregated, so that none is disconnected.
    """
    rng = np.random.default_rng(seed)
    member = np.arange(len(near))
    size = np.ones(len(near))
    graph = near
    while True:
        label = _local_moves(graph, size, resolution, rng)
        label = _connected_parts(graph, label)
        names, label = np.unique(label, return_inverse=True)
        member = label[member]
        if len(names) == len(graph):
            return member
        a, b = label[graph.rows()], label[graph.to]
        apart = a != b
        graph, size = Graph(a[apart], b[apart], graph.weight[apart], len(names)), np.bincount(label, weights=size)


def _local_moves(graph: Graph, size: np.ndarray, resolution: float, rng: np.random.Generator) -> np.ndarray:
    n = len(graph)
    moved = np.arange(n, dtype=np.int32)
    # single entries of a memoryview come much faster than those of its array, and need no copy
    begin, to, weight, label, size, total = map(memoryview, (graph.begin, graph.to, graph.weight, moved, size.astype(float), size.astype(float)))
    first, later = memoryview(rng.permutation(n).astype(np.int32)), deque()  # the queue: all nodes, then those that wait again
    waiting, emptied, empty = bytearray(b"\x01" * n), bytearray(n), []  # empty: a heap of communities that had no member when they came in
    at = 0
    while at < n or later:
        if at < n:
            v, at = first[at], at + 1
        else:
            v = later.popleft()
        waiting[v] = 0
        around, own = range(begin[v], begin[v + 1]), label[v]
        links: dict[int, float] = {}
        for i in around:
            c = label[to[i]]
            links[c] = links.get(c, 0.0) + weight[i]
        mine = size[v]
        total[own] -= mine
        best, gain = own, links.get(own, 0.0) - resolution * mine * total[own]
        for c in sorted(links) if len(links) > 1 else links:
            g = links[c] - resolution * mine * total[c]
            if g > gain + 1e-12:
                best, gain = c, g
        if gain < 0:  # alone is better
            while empty and total[empty[0]] != 0:
                emptied[heappop(empty)] = 0
            best = empty[0] if empty else own
        label[v] = best
        total[best] += mine
        if best != own:
            if total[own] == 0 and not emptied[own]:
                emptied[own] = 1
                heappush(empty, own)
            for i in around:
                u = to[i]
                if label[u] != best and not waiting[u]:
                    waiting[u] = 1
                    later.append(u)
    return moved


def _connected_parts(graph: Graph, label: np.ndarray) -> np.ndarray:
    """Of each node the least node that it reaches within its community."""
    a, b = graph.rows(), graph.to
    inside = label[a] == label[b]
    a, b = a[inside], b[inside]
    part = np.arange(len(graph))
    while len(a):
        least = part.copy()
        np.minimum.at(least, part[a], part[b])  # roots hook on to lesser neighbouring roots
        while not np.array_equal(least, up := least[least]):
            least = up
        part = least[part]
        open_ = part[a] != part[b]
        a, b = a[open_], b[open_]
    return part


def potts_quality(near: Graph, label: np.ndarray, resolution: float) -> float:
    inside = near.weight[label[near.rows()] == label[near.to]].sum() / 2
    sizes = np.bincount(np.unique(label, return_inverse=True)[1])
    return float(inside) - resolution * float((sizes * (sizes - 1) / 2).sum())


def modularity(near: Graph, label: np.ndarray) -> float:
    rows = near.rows()
    degree = np.bincount(rows, weights=near.weight, minlength=len(near))
    twice = degree.sum()
    if not twice:
        return 0.0
    inside = near.weight[label[rows] == label[near.to]].sum()
    return float(inside / twice - (np.bincount(np.unique(label, return_inverse=True)[1], weights=degree) ** 2).sum() / twice**2)


def consensus_communities(near: Graph, resolution: float, runs: int = 16, least: float = 0.05, seed: int = 42) -> np.ndarray:
    """Communities of the graph whose weights are the share of seeded runs that put an edge's ends together, at least `least`."""
    together, rows = np.zeros(len(near.to)), near.rows()
    for r in range(runs):
        label = potts_communities(near, resolution, seed + r)
        together += (label[rows] == label[near.to]) / runs
    return potts_communities(near.weighted(least + (1 - least) * together), resolution, seed)


def pagerank(src: np.ndarray, dst: np.ndarray, n: int, damping: float = 0.85, tolerance: float = 1e-6, rounds: int = 100) -> np.ndarray:
    """Uniform out-edges, dangling mass spread evenly, until the change is below tolerance * n."""
    rank = np.full(n, 1 / max(n, 1))
    out = np.bincount(src, minlength=n)
    dangling = out == 0
    for _ in range(rounds):
        share = np.divide(rank, out, out=np.zeros(n), where=out > 0)
        new = damping * (np.bincount(dst, weights=share[src], minlength=n) + rank[dangling].sum() / n) + (1 - damping) / n
        done = np.abs(new - rank).sum() < n * tolerance
        rank = new
        if done:
            break
    return rank


def best_assignment(weight: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of a one-to-one assignment of largest total weight; pairs of weight 0 are left out.

    Shortest augmenting paths with potentials, on the matrix padded to a square.
    """
    n = max(weight.shape)
    cost = np.zeros((n + 1, n + 1))
    cost[1 : weight.shape[0] + 1, 1 : weight.shape[1] + 1] = -weight
    u, v, match = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, dtype=int)
    for row in range(1, n + 1):
        match[0], column = row, 0
        least, back, used = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int), np.zeros(n + 1, dtype=bool)
        while True:
            used[column] = True
            slack = cost[match[column]] - u[match[column]] - v
            better = ~used & (slack < least)
            better[0] = False
            least[better], back[better] = slack[better], column
            free = np.flatnonzero(~used[1:]) + 1
            following = free[np.argmin(least[free])]
            step = least[following]
            u[match[used]] += step
            v[used] -= step
            least[~used] -= step
            column = following
            if not match[column]:
                break
        while column:
            match[column], column = match[back[column]], back[column]
    pairs = [(int(match[c]) - 1, c - 1) for c in range(1, n + 1)]
    return sorted((r, c) for r, c in pairs if r < weight.shape[0] and c < weight.shape[1] and weight[r, c] > 0)
