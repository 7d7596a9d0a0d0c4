"""Anchored building and merging of fragment graphs.

``Builder`` adds sequences one by one: windows are anchored on nodes of the graph, anchors that cross are dropped,
the rest joins beside its anchors.  Order matters, so a chunk is built in one task; chunks are bounded by their size.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np

from seqloom.operators.kernels import Dag, heaviest_chain, layers, longest_path_nodes, relayered, rising_choice, tightened


def diagonal_blocks(values: list[int | None], weights: list[float]) -> list[tuple[int, int, int, int, float]]:
    """Blocks (first value, last value, first place, last place, weight) of anchors along one diagonal, holes allowed."""
    out: list[list] = []
    for i, v in enumerate(values):
        if v is None:
            continue
        if out and out[-1][5] == v - i:
            out[-1][1], out[-1][3], out[-1][4] = v, i, out[-1][4] + weights[i]
        else:
            out.append([v, v, i, i, weights[i], v - i])
    return [tuple(b[:5]) for b in out]


class Builder:
    """A fragment graph that grows: fragments, weights, headtails, levels, edges, and the path of each sequence."""

    def __init__(self, k: int):
        self.k = k
        self.fragment: list[str] = []
        self.weight: list[int] = []
        self.headtail: list[int] = []
        self.level: list[int] = []
        self.edges: dict[tuple[int, int], int] = defaultdict(int)
        self.index: dict[tuple[int, str], list[int]] = defaultdict(list)  # by role: 0 inner, 1 start, 2 end
        self.paths: list[list[int]] = []
        self.backbone: list[int] = []

    def node(self, fragment: str, headtail: int, level: int) -> int:
        v = len(self.fragment)
        self.fragment.append(fragment)
        self.weight.append(0)
        self.headtail.append(headtail)
        self.level.append(level)
        for role in {1: [1], 2: [2], 3: [1, 2]}.get(headtail, [0]):
            self.index[role, fragment].append(v)
        return v

    def candidates(self, windows: list[str]) -> list[list[int]]:
        last = len(windows) - 1
        roles = [1 if i == 0 else 2 if i == last else 0 for i in range(len(windows))]
        return [self.index.get((r, w), []) for r, w in zip(roles, windows, strict=True)]

    def unique_heaviest(self, nodes: list[int]) -> int | None:
        if len(nodes) < 2:
            return nodes[0] if nodes else None
        top = max(self.weight[v] for v in nodes)
        best = [v for v in nodes if self.weight[v] == top]
        return best[0] if len(best) == 1 else None

    def add(self, seq: str) -> list[int]:
        """Adds a sequence of at least k symbols; gives its path."""
        if len(seq) < self.k:
            raise ValueError(f"a sequence of {len(seq)} symbols is shorter than a fragment ({self.k})")
        windows = [seq[i : i + self.k] for i in range(len(seq) - self.k + 1)]
        n = len(windows)
        near = self.candidates(windows)
        path: list[int | None] = [self.unique_heaviest(c) for c in near]
        if n > 1:
            path[-1] = None
        self.drop_crossing(path)
        at = [None if v is None else self.level[v] for v in path]
        pushed = []
        i = 0
        while i < n:
            if path[i] is not None:
                i += 1
                continue
            j = i
            while j < n and path[j] is None:
                j += 1
            following = at[j] if j < n else None
            first = at[i - 1] + 1 if i else (max(1, following - (j - i)) if following is not None else 1)
            at[i:j] = range(first, first + j - i)
            if following is not None and at[j - 1] >= following:
                pushed.append(path[j])
            i = j
        if not pushed:
            for i, v in enumerate(path):
                if v is None:
                    path[i] = next((c for c in near[i] if self.level[c] == at[i]), None)
        for i, v in enumerate(path):
            if v is None:
                head = (1 if i == 0 else 0) | (2 if i == n - 1 else 0)
                path[i] = self.node(windows[i], head, at[i])
        for a, b in zip(path, path[1:], strict=False):
            self.edges[a, b] += 1
        for v in path:
            self.weight[v] += 1
        if pushed:
            self.relayer(pushed)
        if not self.backbone:
            self.backbone = path[:-1]
        self.paths.append(path)
        return path

    def drop_crossing(self, path: list[int | None]) -> None:
        blocks = diagonal_blocks([None if v is None else self.level[v] for v in path], [0 if v is None else self.weight[v] for v in path])
        for b in heaviest_chain([(v0, v1, w) for v0, v1, _, _, w in blocks]):
            for i in range(blocks[b][2], blocks[b][3] + 1):
                path[i] = None

    def dag(self) -> Dag:
        src, dst = (np.array([e[x] for e in self.edges], np.int64) for x in (0, 1))
        return Dag(len(self.fragment), src, dst, list(self.edges.values()))

    def relayer(self, pushed: list[int]) -> None:
        g = self.dag()
        level = np.array(self.level, np.int64)
        for v in pushed:
            if len(p := g.parents(v)):
                level[v] = max(level[v], level[p].max() + 1)
        level = relayered(g, level, pushed)
        anchored = np.zeros(g.n, bool)
        anchored[self.backbone] = True
        self.level = tightened(g, level, anchored).tolist()

    def merge_equal(self) -> None:
        """Merges nodes of equal fragment, headtail and level, counted backward, then forward, until none are left."""
        while True:
            before = len(self.fragment)
            for forward in (False, True):
                g = self.dag()
                level = layers(g, forward)
                first: dict[tuple, int] = {}
                to = [first.setdefault((f, h, int(c)), v) for v, (f, h, c) in enumerate(zip(self.fragment, self.headtail, level, strict=True))]
                self.renumber(to)
            if len(self.fragment) == before:
                break
        self.level = layers(self.dag()).tolist()

    def renumber(self, to: list[int]) -> None:
        kept = sorted(set(to))
        new = {v: i for i, v in enumerate(kept)}
        at = [new[v] for v in to]
        weight = [0] * len(kept)
        for v, w in zip(at, self.weight, strict=True):
            weight[v] += w
        edges: dict[tuple[int, int], int] = defaultdict(int)
        for (a, b), w in self.edges.items():
            edges[at[a], at[b]] += w
        self.fragment, self.headtail = [self.fragment[v] for v in kept], [self.headtail[v] for v in kept]
        self.level = [self.level[v] for v in kept]
        self.weight, self.edges = weight, edges
        self.paths = [[at[v] for v in p] for p in self.paths]
        self.backbone = [at[v] for v in self.backbone]
        self.index = defaultdict(list)
        for v, (f, h) in enumerate(zip(self.fragment, self.headtail, strict=True)):
            for role in {1: [1], 2: [2], 3: [1, 2]}.get(h, [0]):
                self.index[role, f].append(v)


def built(seqs: list[str], k: int) -> Builder:
    g = Builder(k)
    for s in seqs:
        if len(s) >= k:
            g.add(s)
    g.merge_equal()
    return g


def anchor_targets(base: Builder, other: Builder) -> tuple[dict[int, int], float]:
    """Nodes of the base that nodes of the other graph's heaviest path match, and how much weight they match with."""
    from seqloom.operators.kernels import heaviest_path

    g = base.dag()
    main = heaviest_path(g, ends=[v for v in range(g.n) if base.headtail[v] & 2])
    by_fragment: dict[str, int] = {}
    for v in main:
        if not base.headtail[v]:
            by_fragment.setdefault(base.fragment[v], v)
    o = other.dag()
    path = [v for v in heaviest_path(o, ends=[v for v in range(o.n) if other.headtail[v] & 2]) if not other.headtail[v]]
    target: list[int | None] = [by_fragment.get(other.fragment[v]) for v in path]
    runs: list[list] = []  # strict runs: value and place both grow by one
    for i, t in enumerate(target):
        if t is None:
            continue
        c = base.level[t]
        if runs and runs[-1][3] == i - 1 and runs[-1][1] == c - 1:
            runs[-1][1], runs[-1][3] = c, i
        else:
            runs.append([c, c, i, i])
    for b in heaviest_chain([(r[0], r[1], r[1] - r[0]) for r in runs]):
        for i in range(runs[b][2], runs[b][3] + 1):
            target[i] = None
    matched = sum(base.weight[t] for t in target if t is not None)
    i = 0
    while i < len(path):
        if target[i] is not None:
            i += 1
            continue
        j = i
        while j < len(path) and target[j] is None:
            j += 1
        lo = base.level[target[i - 1]] if i else 0
        hi = base.level[target[j]] if j < len(path) else max(base.level, default=0) + 1
        slots = [
            [(v, base.level[v], base.weight[v]) for v in base.index.get((0, other.fragment[p]), []) if lo < base.level[v] < hi] for p in path[i:j]
        ]
        for p, v in enumerate(rising_choice(slots)):
            target[i + p] = None if v < 0 else v
        i = j
    return {p: t for p, t in zip(path, target, strict=True) if t is not None}, matched


def merged_graphs(a: Builder, b: Builder) -> tuple[Builder, list[int], list[int]]:
    """One graph from two, with the place of each node of a and of b in it.  The base is the one matched with more weight."""
    on_a, weight_a = anchor_targets(a, b)
    on_b, weight_b = anchor_targets(b, a)
    base, other, target = (a, b, on_a) if weight_a >= weight_b else (b, a, on_b)
    out = Builder(base.k)
    for g in (base, other):
        if g is base:
            at = [out.node(f, h, c) for f, h, c in zip(g.fragment, g.headtail, g.level, strict=True)]
            places = [at]
        else:
            at = [target[v] if v in target else out.node(f, h, c) for v, (f, h, c) in enumerate(zip(g.fragment, g.headtail, g.level, strict=True))]
            places.append(at)
        for v, w in zip(at, g.weight, strict=True):
            out.weight[v] += w
        for (x, y), w in g.edges.items():
            out.edges[at[x], at[y]] += w
        out.paths += [[at[v] for v in p] for p in g.paths]
    out.level = layers(out.dag()).tolist()
    out.backbone = longest_path_nodes(out.dag()).tolist()
    n = len(out.fragment)
    marks = list(range(n))
    out.paths.append(marks)  # follows the renumbering
    out.merge_equal()
    final = out.paths.pop()
    first, second = ([final[v] for v in p] for p in places)
    return (out, first, second) if base is a else (out, second, first)
