"""Ordered dynamic programming over one graph, in NumPy and plain Python.

A graph is a set of numbered nodes 0..n-1 with edges (src, dst, weight).  Where results tie, the smallest node wins.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque

import numpy as np


class Dag:
    """Adjacency of a graph, and its nodes in topological order."""

    def __init__(self, n: int, src, dst, weight=None):
        self.n = n
        self.src, self.dst = np.asarray(src, np.int64), np.asarray(dst, np.int64)
        self.weight = np.ones(len(self.src)) if weight is None else np.asarray(weight, np.float64)
        order = np.lexsort((self.src, self.dst))
        self._in = order, np.searchsorted(self.dst[order], np.arange(n + 1))
        order = np.lexsort((self.dst, self.src))
        self._out = order, np.searchsorted(self.src[order], np.arange(n + 1))
        self.order = self._topological()

    def in_edges(self, v: int) -> np.ndarray:
        return self._in[0][self._in[1][v] : self._in[1][v + 1]]

    def out_edges(self, v: int) -> np.ndarray:
        return self._out[0][self._out[1][v] : self._out[1][v + 1]]

    def parents(self, v: int) -> np.ndarray:
        return self.src[self.in_edges(v)]

    def children(self, v: int) -> np.ndarray:
        return self.dst[self.out_edges(v)]

    def _topological(self) -> list[int]:
        left = np.bincount(self.dst, minlength=self.n)
        ready, order = deque(np.flatnonzero(left == 0).tolist()), []
        while ready:
            v = ready.popleft()
            order.append(v)
            for c in self.children(v).tolist():
                left[c] -= 1
                if not left[c]:
                    ready.append(c)
        if len(order) < self.n:
            raise ValueError("the graph has a cycle")
        return order

    def visit(self, operate, forward: bool = True) -> None:
        """Calls operate(node, its parents) in topological order, or (node, its children) in reverse."""
        near = self.parents if forward else self.children
        for v in self.order if forward else reversed(self.order):
            operate(v, near(v))


def layers(g: Dag, forward: bool = True) -> np.ndarray:
    """Longest-path level of each node, from 1: from the sources, or from the sinks."""
    level = np.ones(g.n, np.int64)

    def operate(v: int, near: np.ndarray) -> None:
        if len(near):
            level[v] = level[near].max() + 1

    g.visit(operate, forward)
    return level


def tightened(g: Dag, level: np.ndarray, anchored: np.ndarray) -> np.ndarray:
    """Levels with nodes that no anchored node leads to moved right, next to their nearest child."""
    fixed = np.array(anchored, bool)
    for v in g.order:
        if not fixed[v] and len(p := g.parents(v)):
            fixed[v] = fixed[p].any()
    level = level.copy()
    for v in reversed(g.order):
        if not fixed[v] and len(c := g.children(v)):
            level[v] = level[c].min() - 1
    return level


def relayered(g: Dag, level: np.ndarray, pushed: list[int]) -> np.ndarray:
    """Levels after nodes were moved to the right: their descendants keep at least one level's distance."""
    level, moved = level.copy(), np.zeros(g.n, bool)
    moved[pushed] = True
    for v in g.order:
        p = g.parents(v)
        if len(p) and moved[p].any() and level[p].max() + 1 > level[v]:
            level[v] = level[p].max() + 1
            moved[v] = True
    return level


def longest_path_nodes(g: Dag) -> np.ndarray:
    """Nodes on some longest path."""
    level = layers(g)
    on = level == level.max() if g.n else np.zeros(0, bool)
    for v in reversed(g.order):
        c = g.children(v)
        on[v] |= bool((on[c] & (level[c] == level[v] + 1)).any())
    return np.flatnonzero(on)


def heaviest_path(g: Dag, starts=None, ends=None) -> list[int]:
    """The path with the largest sum of edge weights that ends in ``ends`` (any node without children if not given).

    A single node is a path of weight 0, so there is always one in a graph with nodes.
    """
    if not g.n:
        return []
    best, back = np.zeros(g.n), np.full(g.n, -1)
    may = np.ones(g.n, bool) if starts is None else np.isin(np.arange(g.n), starts)
    reach = may.copy()
    for v in g.order:
        e = g.in_edges(v)
        e = e[reach[g.src[e]]]
        if len(e):
            total = best[g.src[e]] + g.weight[e]
            k = int(np.argmax(total))
            if not may[v] or total[k] > 0:
                best[v], back[v], reach[v] = total[k], g.src[e[k]], True
    ends = [v for v in range(g.n) if not len(g.children(v))] if ends is None else sorted(ends)
    ends = [v for v in ends if reach[v]]
    if not ends:
        return []
    v = max(ends, key=lambda x: (best[x], -x))
    path = [int(v)]
    while back[v] >= 0:
        v = back[v]
        path.append(int(v))
    return path[::-1]


def reachable(g: Dag, sources, forward: bool = True, allowed=None) -> np.ndarray:
    """Nodes reached from sources (included) through allowed nodes."""
    fine = np.ones(g.n, bool) if allowed is None else np.asarray(allowed, bool)
    seen = np.zeros(g.n, bool)
    seen[[s for s in sources if fine[s]]] = True
    queue, near = deque(np.flatnonzero(seen).tolist()), g.children if forward else g.parents
    while queue:
        for c in near(queue.popleft()).tolist():
            if fine[c] and not seen[c]:
                seen[c] = True
                queue.append(c)
    return seen


def stays_acyclic(g: Dag, nodes) -> bool:
    """Whether the nodes can become one without a cycle: none of them leads to another."""
    nodes = set(nodes)
    return not any(nodes & set(np.flatnonzero(reachable(g, g.children(v).tolist())).tolist()) for v in nodes)


def without_degenerate(g: Dag, clean: np.ndarray, starts, ends) -> np.ndarray:
    """Clean nodes on a path of clean nodes from a start to an end."""
    kept = reachable(g, starts, True, clean) & reachable(g, ends, False, clean)
    if not kept.any():
        raise ValueError("no path without degenerate symbols")
    return kept


def islands(n: int, src, dst) -> np.ndarray:
    """Smallest node of each node's connected component, directions ignored."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(src, dst, strict=True):
        a, b = find(int(a)), find(int(b))
        if a != b:
            root[max(a, b)] = min(a, b)
    return np.array([find(x) for x in range(n)], np.int64)


def unitigs(g: Dag) -> tuple[np.ndarray, list[list[int]], list[tuple[int, int, float]]]:
    """Path of each node, the paths (maximal chains without branches), and the edges between paths."""
    n_in, n_out = np.bincount(g.dst, minlength=g.n), np.bincount(g.src, minlength=g.n)
    of, paths = np.full(g.n, -1), []
    for v in g.order:
        if of[v] >= 0:
            continue
        path = [v]
        while n_out[path[-1]] == 1 and n_in[c := int(g.children(path[-1])[0])] == 1:
            path.append(c)
        of[path] = len(paths)
        paths.append([int(p) for p in path])
    links = [(int(of[s]), int(of[d]), float(w)) for s, d, w in zip(g.src, g.dst, g.weight, strict=True) if of[s] != of[d]]
    return of, paths, links


def state_ranges(g: Dag, reference, length: int, extend: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Profile positions each node can have, given the positions of reference nodes (node or None for each position)."""
    lo, hi = np.zeros(g.n, np.int64), np.full(g.n, length, np.int64)
    for i, v in enumerate(reference):
        if v is not None:
            lo[v] = hi[v] = i
    for v in g.order:
        if len(p := g.parents(v)):
            lo[v] = max(lo[v], lo[p].max())
    for v in reversed(g.order):
        if len(c := g.children(v)):
            hi[v] = min(hi[v], hi[c].min())
    if extend:
        hi = np.array([max([hi[v], *hi[g.children(v)]]) for v in range(g.n)], np.int64)
    return lo, hi


def heaviest_chain(blocks: list[tuple[int, int, float]]) -> list[int]:
    """Places of blocks (start, end, weight) to take out so that the rest rise strictly and weigh most.

    Nothing goes if neighbours already rise; of equal sums the first found stays.
    """
    if all(a[1] < b[0] for a, b in zip(blocks, blocks[1:], strict=False)):
        return []
    best, back = [], []
    for i, (start, _, weight) in enumerate(blocks):
        total, prev = weight, -1
        for j in range(i):
            if blocks[j][1] < start and best[j] + weight > total:
                total, prev = best[j] + weight, j
        best.append(total)
        back.append(prev)
    i, kept = max(range(len(blocks)), key=lambda x: (best[x], -x)), set()
    while i >= 0:
        kept.add(i)
        i = back[i]
    return [i for i in range(len(blocks)) if i not in kept]


def rising_choice(slots: list[list[tuple[int, int, float]]], optimal: bool = False) -> list[int]:
    """One candidate (node, coordinate, weight) or -1 for each slot, coordinates strictly rising, weights large.

    Only the best state of each earlier slot is looked at, as the aligner's results ask for; ``optimal`` looks at all.
    """
    states: list[list[tuple[float, int, list[int]]]] = []  # of each slot: total, coordinate, choice
    for s, candidates in enumerate(slots):
        found = []
        for node, coord, weight in candidates:
            total, choice = weight, [-1] * s
            for before in states:
                for t, c, picked in before:
                    if c < coord and t > 0 and t + weight > total:
                        total, choice = t + weight, picked + [-1] * (s - len(picked))
            found.append((total, coord, [*choice, node]))
        if not optimal and found:
            found = [max(found, key=lambda f: f[0])]
        states.append(found)
    best = max((f for st in states for f in st), key=lambda f: f[0], default=None)
    return best[2] + [-1] * (len(slots) - len(best[2])) if best else [-1] * len(slots)


def longest_rise(values: list[int | None]) -> list[int | None]:
    """The values of a longest strictly rising choice in their places; all others None."""
    ends: list[int] = []  # smallest last value of a rise of each length
    at, back = [], [-1] * len(values)
    for i, v in enumerate(values):
        if v is None:
            continue
        k = bisect_left(ends, v)
        back[i] = at[k - 1] if k else -1
        if k == len(ends):
            ends.append(v)
            at.append(i)
        else:
            ends[k], at[k] = v, i
    out: list[int | None] = [None] * len(values)
    i = at[-1] if at else -1
    while i >= 0:
        out[i], i = values[i], back[i]
    return out
