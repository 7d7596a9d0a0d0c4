"""Windowed profile hidden Markov model over a graph of single symbols.

L match columns: M_j and D_j for j < L, I_j for j <= L (I_j comes before M_j).  Transitions are stored at the position
they lead to: ``mm[j]`` is M_{j-1} to M_j, ``mi[j]`` M_{j-1} to I_j, ``im[j]`` I_j to M_j, and so on; index 0 of mm, md
and mi is the start, index L of mm, dm and im the end.  A node sees only the positions of its window.  Values are
natural logarithms.  The graph is walked in topological order; an edge into a node has the prior of its share in the
node's incoming weight, an end node that of its share of the sequences.
"""

from __future__ import annotations

import numpy as np

from seqloom.functions.symbols import EMITTED, STANDS_FOR
from seqloom.operators.build import Builder
from seqloom.operators.consensus import BASES, Consensus
from seqloom.operators.kernels import Dag, state_ranges, without_degenerate

NONE = -np.inf
WINDOW = 100
#: Fixed pseudocounts (logarithms) of the M-step.
ADD = {"mm": -3.0, "md": -4.0, "mi": -50.0, "pi": -1.0, "im": -1.0, "ii": -1.0, "iend": -1.0, "mend": -10.0, "mi_tail": -10.0}


def lse(*arrays: np.ndarray) -> np.ndarray:
    out = arrays[0]
    for a in arrays[1:]:
        out = np.logaddexp(out, a)
    return out


def all_emissions(logs: np.ndarray) -> np.ndarray:
    """positions x 15: degenerate symbols are the mean over what they stand for."""
    columns = []
    for s in EMITTED:
        some = logs[:, [BASES.index(b) for b in STANDS_FOR[s]]]
        columns.append(np.logaddexp.reduce(some, axis=1) - np.log(some.shape[1]))
    return np.stack(columns, 1)


def joined(a: np.ndarray, at: int, b: np.ndarray, b_at: int, combine) -> None:
    """Combine b, whose first position is b_at, into a, whose first is at, where both have positions."""
    lo, hi = max(at, b_at), min(at + len(a), b_at + len(b))
    if lo < hi:
        part = a[lo - at : hi - at]
        combine(part, b[lo - b_at : hi - b_at], out=part)


class Model:
    """Parameters laid over a graph: windows, priors, and the passes.

    Each node's values are three arrays (M, I, D) over the positions lo .. hi of its window; M and D have none at L.  Time
    and memory go with nodes and edges times the window, not times the profile.  With ``clean_only`` nodes off all paths
    of unambiguous symbols are left out, unless there is no such path.
    """

    def __init__(self, g: Builder, ref: Consensus, p: dict[str, np.ndarray], window: int = WINDOW, clean_only: bool = False):
        self.g, self.p, self.L = g, p, len(p["match"])
        whole = g.dag()
        lo, hi = state_ranges(whole, ref.nodes, self.L)
        self.lo, self.hi = np.maximum(0, lo - window), np.minimum(self.L, hi + window)
        kept = self.clean_nodes(whole) if clean_only else np.ones(whole.n, bool)
        both = kept[whole.src] & kept[whole.dst]
        self.dag = Dag(whole.n, whole.src[both], whole.dst[both], whole.weight[both])
        self.symbol = np.array([EMITTED.index(f) if f in EMITTED else EMITTED.index("N") for f in g.fragment])
        none = np.full((1, len(EMITTED)), NONE)
        self.me, self.ie = np.concatenate([all_emissions(p["match"]), none]), all_emissions(p["insert"])
        into = np.bincount(self.dag.dst, self.dag.weight, minlength=self.dag.n)
        self.prior = np.log(self.dag.weight / into[self.dag.dst]) if len(self.dag.dst) else np.zeros(0)
        self.starts = {v for v in range(self.dag.n) if g.headtail[v] & 1 and kept[v]}
        self.ends = [v for v in range(self.dag.n) if g.headtail[v] & 2 and kept[v]]
        total = sum(g.weight[v] for v in self.ends)
        self.end_prior = {v: float(np.log(g.weight[v] / total)) for v in self.ends}
        # sums of dd up to each position turn the chain of deletions into one accumulation
        dd = np.where(np.isfinite(p["dd"][: self.L]), p["dd"][: self.L], 0.0)
        self.chain = np.concatenate([np.cumsum(np.concatenate([[0.0], dd[1:]])), [0.0]]) if self.L else np.zeros(1)
        #: the silent chain D_0 .. D_{L-1} from the start, with nothing before and after it
        self.silent = np.concatenate([[NONE], p["md"][0] + self.chain[: self.L], [NONE]])
        self.to = {k: np.append(x, NONE) for k, x in p.items() if x.ndim == 1}  # one more position, of which nothing comes
        self.order = [v for v in self.dag.order if kept[v]]

    def clean_nodes(self, dag: Dag) -> np.ndarray:
        clean = np.array([f in BASES for f in self.g.fragment], bool)
        sides = ([v for v in range(dag.n) if self.g.headtail[v] & side] for side in (1, 2))
        try:
            return without_degenerate(dag, clean, *sides)
        except ValueError:
            return np.ones(dag.n, bool)

    def full(self, v: int, kept: tuple) -> list[np.ndarray]:
        """M, I, D of a node over the whole profile."""
        lo, out = int(self.lo[v]), []
        for x, n in zip(kept, (self.L, self.L + 1, self.L), strict=True):
            a = np.full(n, NONE)
            a[lo : lo + len(x)] = x[: max(0, n - lo)]
            out.append(a)
        return out

    def deletions(self, lo: int, m: np.ndarray, i: np.ndarray, combine) -> np.ndarray:
        """D_j from M_{j-1}, I_j and D_{j-1} of the same node."""
        w = len(m)
        enter = i + self.to["id"][lo : lo + w]
        combine(enter[1:], m[:-1] + self.to["md"][lo + 1 : lo + w], out=enter[1:])
        d = combine.accumulate(enter - self.chain[lo : lo + w]) + self.chain[lo : lo + w]
        if lo + w > self.L:
            d[-1] = NONE
        return d

    def step(self, v: int, values: dict, combine) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The node's values from its parents'."""
        lo, hi, s, p = int(self.lo[v]), int(self.hi[v]), self.symbol[v], self.to
        w = hi - lo + 1
        fm, fi, fd = (np.full(w + 1, NONE) for _ in range(3))  # what the parents bring, from position lo - 1 on
        for e in self.dag.in_edges(v).tolist():
            u, share = int(self.dag.src[e]), self.prior[e]
            for target, x in zip((fm, fi, fd), values[u], strict=True):
                joined(target, lo - 1, x + share, int(self.lo[u]), combine)
        if v in self.starts:
            joined(fd, lo - 1, self.silent, -1, combine)
        at = slice(lo, hi + 1)
        m = self.me[at, s] + combine(combine(fm[:-1] + p["mm"][at], fd[:-1] + p["dm"][at]), fi[1:] + p["im"][at])
        i = self.ie[at, s] + combine(combine(fm[:-1] + p["mi"][at], fd[:-1] + p["di"][at]), fi[1:] + p["ii"][at])
        if v in self.starts and lo == 0:
            m[0] = combine(m[0], self.p["mm"][0] + self.me[0, s])
            i[0] = combine(i[0], self.p["mi"][0] + self.ie[0, s])
        return m, i, self.deletions(lo, m, i, combine)

    # -- passes

    def swept(self, combine) -> dict:
        values: dict[int, tuple] = {}
        for v in self.order:
            values[v] = self.step(v, values, combine)
        return values

    def forward(self) -> tuple[dict, float]:
        """Forward values of each node, and ln P."""
        f = self.swept(np.logaddexp)
        total = NONE
        for v, share in self.end_prior.items():
            total = np.logaddexp(total, share + self.finish(*self.full(v, f[v]), np.logaddexp))
        return f, float(total)

    def finish(self, m, i, d, combine) -> float:
        """From the values over the whole profile to the end."""
        p = self.p
        return float(combine(combine(m[-1] + p["mm"][-1], d[-1] + p["dm"][-1]), i[-1] + p["im"][-1]))

    def backward(self) -> tuple[dict, float, np.ndarray]:
        """Backward values of each node, ln P, and the backward values of the silent chain before the first symbol."""
        p, n, b, total = self.to, self.L, {}, NONE
        begin = np.full(n, NONE)
        for v in reversed(self.order):
            lo, hi = int(self.lo[v]), int(self.hi[v])
            w = hi - lo + 1
            gm, gi = np.full(w + 1, NONE), np.full(w + 1, NONE)  # what the children bring, up to position hi + 1
            for e in self.dag.out_edges(v).tolist():
                c, share = int(self.dag.dst[e]), self.prior[e]
                at, s = slice(int(self.lo[c]), int(self.hi[c]) + 1), self.symbol[c]
                joined(gm, lo, share + self.me[at, s] + b[c][0], int(self.lo[c]), np.logaddexp)
                joined(gi, lo, share + self.ie[at, s] + b[c][1], int(self.lo[c]), np.logaddexp)
            last = self.end_prior.get(v, NONE)
            here, ahead, inner = slice(lo, hi + 1), slice(lo + 1, hi + 2), n - 1 - lo  # place of position L - 1
            d = np.logaddexp(p["dm"][ahead] + gm[1:], p["di"][ahead] + gi[1:])
            if 0 <= inner < w:
                d[inner] = np.logaddexp(d[inner], p["dm"][n] + last)
            if hi == n:
                d[-1] = NONE
            chain = self.chain[here]
            d = np.logaddexp.accumulate((d + chain)[::-1])[::-1] - chain
            if hi == n:
                d[-1] = NONE
            m = lse(p["mm"][ahead] + gm[1:], p["mi"][ahead] + gi[1:], p["md"][ahead] + np.append(d[1:], NONE))
            if 0 <= inner < w:
                m[inner] = np.logaddexp(m[inner], p["mm"][n] + last)
            i = lse(p["im"][here] + gm[:-1], p["ii"][here] + gi[:-1], p["id"][here] + d)
            if hi == n:
                m[-1] = NONE
                i[-1] = np.logaddexp(i[-1], p["im"][n] + last)
            b[v] = m, i, d
            if v in self.starts:
                s = self.symbol[v]
                at_m, at_i = self.me[here, s] + m, self.ie[here, s] + i
                if lo == 0:
                    total = lse(total, self.p["mm"][0] + at_m[0], self.p["mi"][0] + at_i[0])
                joined(begin, 0, np.logaddexp(p["dm"][here] + at_m, p["di"][here] + at_i), lo - 1, np.logaddexp)
        total = np.logaddexp(total, np.logaddexp.reduce(self.silent[1:-1] + begin)) if n else total
        return b, float(total), begin

    def expectations(self) -> list[tuple[str, int, str, float]]:
        """Expected counts as rows (kind, position, symbol or empty, logarithm)."""
        f, _ = self.forward()
        b, total, begin = self.backward()
        p, n = self.to, self.L
        emit = np.full((n + 1, len(EMITTED)), NONE)
        kinds = {k: np.full(n + 1, NONE) for k in ("occ_m", "occ_i", "occ_d", "mm", "md", "mi", "im", "id", "ii")}
        start = np.full(3, NONE)

        def count(kind: str, lo: int, x: np.ndarray) -> None:
            part = kinds[kind][lo : lo + len(x)]
            np.logaddexp(part, x, out=part)

        for v in self.order:
            lo, s = int(self.lo[v]), self.symbol[v]
            (fm, fi, fd), (bm, bi, bd) = f[v], b[v]
            w = len(fm)
            gm = fm + bm - total
            np.logaddexp(emit[lo : lo + w, s], gm, out=emit[lo : lo + w, s])
            count("occ_m", lo, gm)
            count("occ_i", lo, fi + bi - total)
            count("occ_d", lo, fd + bd - total)
            count("md", lo + 1, fm[:-1] + p["md"][lo + 1 : lo + w] + bd[1:] - total)
            count("id", lo, fi + p["id"][lo : lo + w] + bd - total)
            em, ei = self.me[lo : lo + w, s] + bm, self.ie[lo : lo + w, s] + bi
            for e in self.dag.in_edges(v).tolist():
                u, share = int(self.dag.src[e]), self.prior[e] - total
                um, ui, _ = f[u]
                u_lo = int(self.lo[u])
                for kind, x, at, y in (("mm", um, u_lo + 1, em), ("mi", um, u_lo + 1, ei), ("im", ui, u_lo, em), ("ii", ui, u_lo, ei)):
                    first, after = max(lo, at), min(lo + w, at + len(x))
                    if first < after:
                        count(kind, first, x[first - at : after - at] + share + p[kind][first:after] + y[first - lo : after - lo])
            if v in self.starts and lo == 0:
                start[0] = np.logaddexp(start[0], self.p["mm"][0] + em[0] - total)
                start[1] = np.logaddexp(start[1], self.p["mi"][0] + ei[0] - total)
        start[2] = np.logaddexp.reduce(self.silent[1:-1] + begin) - total if n else NONE
        rows = [("emit", j, EMITTED[s], float(emit[j, s])) for j, s in zip(*np.nonzero(emit > NONE), strict=True)]
        rows += [(k, int(j), "", float(x[j])) for k, x in kinds.items() for j in np.flatnonzero(x > NONE)]
        return rows + [("start", i, "", float(x)) for i, x in enumerate(start)]

    def viterbi(self) -> dict:
        """Best values of each node."""
        return self.swept(np.maximum)

    def value(self, best: dict, v: int, state: int, j: int) -> float:
        k = j - int(self.lo[v])
        x = best[v][state]
        return float(x[k]) if 0 <= k < len(x) else NONE

    def collapse(self, best: dict, v: int, state: int, j: int) -> tuple[int, int]:
        """From a deletion back to the match or insert of the same node that leads to it; before all, position -1."""
        while state == 2:
            p = self.p
            options = (
                (self.value(best, v, 0, j - 1) + p["md"][j] if j else NONE, 0, j - 1),
                (self.value(best, v, 2, j - 1) + p["dd"][j] if j else NONE, 2, j - 1),
                (self.value(best, v, 1, j) + p["id"][j], 1, j),
            )
            top = max(options, key=lambda o: o[0])
            if top[0] == NONE:
                return 0, j
            _, state, j = top
        return state, j

    def chosen(self, best: dict, v: int, before: tuple[int, int], prior: float) -> tuple[float, tuple[int, int]]:
        """Value and state at a parent that a state (state, j) of the child comes from; ties in the order M, D, I."""
        state, j = before
        p = self.p
        kinds = (("mm", "dm", "im") if state == 0 else ("mi", "di", "ii"))
        options = [
            (self.value(best, v, 0, j - 1) + p[kinds[0]][j] + prior if j else NONE, (0, j - 1)),
            (self.value(best, v, 2, j - 1) + p[kinds[1]][j] + prior if j else NONE, (2, j - 1)),
            (self.value(best, v, 1, j) + p[kinds[2]][j] + prior, (1, j)),
        ]
        return max(options, key=lambda o: o[0])

    def traced(self, best: dict, path: list[int]) -> list[tuple[int, int, int]]:
        """(state: 0 match, 2 insert; position; inserts still to come at it) of each symbol of one sequence.

        A child's state asks for one state among all its parents; if that is at the sequence's own parent it holds,
        else the sequence's parent chooses for itself.
        """
        p, v = self.p, path[-1]
        n = self.L
        ends = [(self.value(best, v, 0, n - 1) + p["mm"][-1], 0, n - 1), (self.value(best, v, 2, n - 1) + p["dm"][-1], 2, n - 1), (self.value(best, v, 1, n) + p["im"][-1], 1, n)]
        _, state, j = max(ends, key=lambda o: o[0])
        state, j = self.collapse(best, v, state, j)
        run, out = 0, [(2 if state == 1 else 0, j, 0)]
        for u in reversed(path[:-1]):
            options = []
            for e in self.dag.in_edges(v).tolist():
                w = int(self.dag.src[e])
                options.append((self.chosen(best, w, (state, j), self.prior[e]), w))
            wanted = max(options, key=lambda o: o[0][0])[0][1]
            own = next(o for o, w in options if w == u)
            holds = max((o[0] for o, w in options if o[1] == wanted), default=NONE) == own[0] and own[1] == wanted
            target = wanted if holds else own[1]
            after = (state, j)
            state, j = self.collapse(best, u, *target)
            run = run + 1 if state == 1 and after == (1, j) else 0
            out.append((2 if state == 1 else 0, j, run))
            v = u
        return out[::-1]


def re_estimated(p: dict[str, np.ndarray], counts: dict[tuple[str, int, str], float], pseudocount: float) -> dict[str, np.ndarray]:
    """The parameters after one M-step on summed expected counts (logarithms by kind, position, symbol)."""
    n = len(p["match"])

    def of(kind: str, size: int) -> np.ndarray:
        return np.array([counts.get((kind, j, ""), NONE) for j in range(size)])

    def share(x: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return np.where(np.isfinite(whole), x - np.where(np.isfinite(whole), whole, 0.0), NONE)

    new = {k: x.copy() for k, x in p.items()}
    occ_m, occ_i = of("occ_m", n), of("occ_i", n + 1)
    match = np.full((n, 4), NONE)
    for (kind, j, s), x in counts.items():
        if kind == "emit":
            bases = STANDS_FOR[s]
            for b in bases:
                match[j, BASES.index(b)] = np.logaddexp(match[j, BASES.index(b)], x - np.log(len(bases)))
    match = np.logaddexp(np.where(np.isfinite(occ_m)[:, None], match - np.where(np.isfinite(occ_m), occ_m, 0.0)[:, None], NONE), pseudocount)
    new["match"] = match - np.logaddexp.reduce(match, axis=1, keepdims=True)
    new["insert"] = np.full((n + 1, 4), np.log(0.25))
    mm, md, mi = of("mm", n + 1), of("md", n + 1), of("mi", n + 1)
    inner = slice(1, n)
    three = [np.logaddexp(share(x[inner], occ_m[: n - 1]), ADD[k]) for k, x in (("mm", mm), ("mi", mi), ("md", md))]
    whole = lse(*three)
    new["mm"][inner], new["mi"][inner], new["md"][inner] = (x - whole for x in three)
    tail = np.array([np.logaddexp(p["mm"][n], ADD["mend"]), np.logaddexp(share(mi[n:], occ_m[n - 1 :])[0], ADD["mi_tail"])])
    new["mm"][n], new["mi"][n] = tail - np.logaddexp.reduce(tail)
    im, ii = of("im", n + 1), of("ii", n + 1)
    a, b = p["im"][:n].copy(), p["ii"][:n].copy()
    a[1:], b[1:] = share(im[1:n], occ_i[1:n]), share(ii[1:n], occ_i[1:n])
    a, b = np.logaddexp(a, ADD["im"]), np.logaddexp(b, ADD["ii"])
    new["im"][:n], new["ii"][:n] = a - lse(a, b), b - lse(a, b)
    tail = np.array([np.logaddexp(p["im"][n], ADD["iend"]), np.logaddexp(p["ii"][n], ADD["ii"])])
    new["im"][n], new["ii"][n] = tail - np.logaddexp.reduce(tail)
    new["dm"][inner] = new["dd"][inner] = np.log(0.5)
    start = np.array([counts.get(("start", i, ""), NONE) for i in range(3)])
    start = np.logaddexp(start - np.logaddexp.reduce(start), ADD["pi"])
    new["mm"][0], new["mi"][0], new["md"][0] = start - np.logaddexp.reduce(start)
    return new
