"""Consensus of a graph of single symbols: reference path, column frequencies, places of inserts; and the start parameters."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions.symbols import STANDS_FOR, log_sum_exp
from seqloom.operators.build import Builder
from seqloom.operators.kernels import Dag, heaviest_path, islands, layers, reachable, state_ranges, unitigs

BASES = "ATCG"
#: Fixed start values (natural logarithms) and the grid of (stem threshold, emission pseudocount).
HALF = float(np.log(0.5))
START = {"M2D": -2.0, "M2I": -5.0, "I2I": HALF, "D2M": HALF, "M2End": HALF}
GRID = [(0.001, -3.0), (0.001, -5.0)]


def symbol_graph(g: Builder) -> tuple[Builder, list[int]]:
    """The graph with fragments of one symbol, and the place of each node of ``g`` (its last symbol) in it.

    A start node brings a chain for the symbols before its last.
    """
    out = Builder(1)
    chain: dict[int, list[int]] = {}
    at = []
    for v, (f, h) in enumerate(zip(g.fragment, g.headtail, strict=True)):
        if h & 1 and g.k > 1:
            chain[v] = [out.node(s, 1 if i == 0 else 0, i + 1) for i, s in enumerate(f[:-1])]
            h &= 2
        at.append(out.node(f[-1], h, g.level[v] + g.k - 1))
    for v, nodes in chain.items():
        for a, b in zip(nodes, [*nodes[1:], at[v]], strict=True):
            out.edges[a, b] += g.weight[v]
        for a in nodes:
            out.weight[a] += g.weight[v]
    for v, w in enumerate(g.weight):
        out.weight[at[v]] += w
    for (a, b), w in g.edges.items():
        out.edges[at[a], at[b]] += w
    out.paths = [chain.get(p[0], []) + [at[v] for v in p] for p in g.paths]
    out.paths.append(at)  # follows the renumbering
    out.merge_equal()
    return out, out.paths.pop()


@dataclass
class Consensus:
    nodes: list[int]
    frequency: np.ndarray  # length x 4
    inserts: list[tuple[int, int]]

    @property
    def sequence(self) -> str:
        return "".join(BASES[i] for i in self.frequency.argmax(1))


def merged_intervals(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union; touching ones merge."""
    out: list[list[int]] = []
    for lo, hi in sorted(ranges):
        if out and out[-1][1] >= lo:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(r) for r in out]


def stem(g: Builder, dag: Dag, share: float) -> np.ndarray:
    """Nodes on strong edges between a clean start and a clean end; strong: more than ``share`` of both ends' weight."""
    weight, clean = np.array(g.weight, float), np.array([f in BASES for f in g.fragment], bool)
    strong = (dag.weight > share * weight[dag.src]) & (dag.weight > share * weight[dag.dst]) & clean[dag.src] & clean[dag.dst]
    sub = Dag(dag.n, dag.src[strong], dag.dst[strong], dag.weight[strong])
    starts = [v for v in range(dag.n) if g.headtail[v] & 1]
    ends = [v for v in range(dag.n) if g.headtail[v] & 2]
    return reachable(sub, starts, True, clean) & reachable(sub, ends, False, clean)


def consensus(g: Builder, share: float = 0.001) -> Consensus:
    """Reference path and column votes of a graph of single symbols.

    The path is the heaviest one over unitigs of the stem, where only edges between unitigs weigh.  Islands beside it
    that span as many levels as the reference between their neighbours vote in its columns; deeper ones mark inserts.
    """
    dag = g.dag()
    inside = stem(g, dag, share)
    if not inside.any():
        inside = np.ones(dag.n, bool)
    both = inside[dag.src] & inside[dag.dst]
    sub = Dag(dag.n, dag.src[both], dag.dst[both], dag.weight[both])
    _, paths, links = unitigs(sub)
    paths_in = [i for i, p in enumerate(paths) if inside[p[0]]]
    coarse = Dag(len(paths), *([x[i] for x in links] for i in range(3)))
    ends = [i for i in paths_in if not len(coarse.children(i))]
    nodes = [v for p in heaviest_path(coarse, starts=paths_in, ends=ends) for v in paths[p]]
    on = np.zeros(dag.n, bool)
    on[nodes] = True
    votes = [[v] for v in nodes]
    lo, hi = state_ranges(dag, nodes, len(nodes))
    side = ~on[dag.src] & ~on[dag.dst]
    inserts = []
    if side.any():
        label = islands(dag.n, dag.src[side], dag.dst[side])
        level = layers(Dag(dag.n, dag.src[side], dag.dst[side]))
        touched = np.unique(np.concatenate([dag.src[side], dag.dst[side]]))
        for island in np.unique(label[touched]).tolist():
            members = touched[label[touched] == island]
            left, right = int(lo[members].min()), int(hi[members].max())
            depth, gap = int(level[members].max() - level[members].min() + 1), right - left - 1
            if depth == gap:
                for v in members.tolist():
                    if left + int(level[v]) < len(votes):
                        votes[left + int(level[v])].append(v)
            elif depth > gap:
                inserts.append((left, right))
    frequency = np.zeros((len(nodes), 4))
    for j, voters in enumerate(votes):
        for v in voters:
            bases = STANDS_FOR.get(g.fragment[v], "ATCG")
            for b in bases:
                frequency[j, BASES.index(b)] += g.weight[v] / len(bases)
    frequency /= np.maximum(frequency.sum(1, keepdims=True), 1e-300)
    return Consensus(nodes, frequency, merged_intervals(inserts))


# ---- the same in tables: profile (pos, base, prob)


def profile_columns(bases: DataFrame) -> DataFrame:
    """Counts n_a .. n_g of each col -> rows pos, base, prob; columns without bases have none."""
    total = F.col("n_a") + F.col("n_t") + F.col("n_c") + F.col("n_g")
    pairs = F.array(*[F.struct(F.lit(b).alias("base"), (F.col(f"n_{b.lower()}") / total).alias("prob")) for b in BASES])
    return bases.where(total > 0).select(F.col("col").alias("pos"), F.inline(pairs))


def consensus_rows(profile: DataFrame) -> DataFrame:
    """The likeliest base of each position, ties in the order A, T, C, G."""
    rank = F.instr(F.lit(BASES), F.col("base"))
    return profile.groupBy("pos").agg(F.max_by("base", F.struct("prob", -rank)).alias("base"))


def smoothed(profile: DataFrame, pseudocount: float) -> DataFrame:
    """Probabilities with exp(pseudocount) added and normalised."""
    total = profile.groupBy("pos").agg(F.sum(F.col("prob") + F.exp(F.lit(pseudocount))).alias("total"))
    return profile.join(total, "pos").select("pos", "base", ((F.col("prob") + F.exp(F.lit(pseudocount))) / F.col("total")).alias("prob"))


def degenerate_emissions(emissions: DataFrame) -> DataFrame:
    """pos, symbol, logp for all 15 symbols from pos, base, logp: the logarithm of the mean over what a symbol stands for."""
    pairs = [(s, b, len(bases)) for s, bases in STANDS_FOR.items() for b in bases]
    table = F.array(*[F.struct(F.lit(s).alias("symbol"), F.lit(b).alias("of"), F.lit(n).alias("n")) for s, b, n in pairs])
    rows = emissions.select("pos", "base", "logp", F.inline(table)).where("base = of")
    return log_sum_exp(rows.select("pos", "symbol", (F.col("logp") - F.log("n")).alias("logp")), ["pos", "symbol"], "logp")


def start_transitions(length: int, spark, inserts: list[tuple[int, int]] = ()) -> DataFrame:
    """pos (0 to length), kind, logp of the model's start values."""
    p = start_parameters(np.full((length, 4), 0.25), inserts)
    pos = spark.range(length + 1).select(F.col("id").cast("int").alias("pos"))
    hot = F.lit(False)
    for lo, hi in inserts:
        hot = hot | F.col("pos").between(lo, hi - 1)
    mid = max(1, min(length - 1, 1))
    first, last = F.col("pos") == 0, F.col("pos") == length
    kinds = []
    for kind in ("mm", "md", "mi", "im", "id", "ii", "dm", "dd", "di"):
        plain = float(p[kind][next((i for i in range(1, length) if not any(a <= i < b for a, b in inserts)), mid)])
        inner = next((i for i in range(1, length) if any(a <= i < b for a, b in inserts)), None)
        value = F.when(first, float(p[kind][0])).when(last, float(p[kind][length]))
        value = value.when(hot, float(p[kind][inner])) if inner is not None else value
        kinds.append(F.struct(F.lit(kind).alias("kind"), value.otherwise(plain).alias("logp")))
    return pos.select("pos", F.inline(F.array(*kinds)))


def start_parameters(emission: np.ndarray, inserts=(), values=None) -> dict[str, np.ndarray]:
    """Log transitions (length + 1 each), match emissions (length x 4) and insert emissions ((length + 1) x 4)."""
    v = values or START
    n = len(emission) + 1
    if np.exp(v["M2D"]) + np.exp(v["M2I"]) >= 1:
        raise ValueError("M2D and M2I leave nothing for M2M")
    p = {
        "mm": np.full(n, np.log(1 - np.exp(v["M2D"]) - np.exp(v["M2I"]))), "md": np.full(n, v["M2D"]), "mi": np.full(n, v["M2I"]),
        "im": np.full(n, np.log(1 - np.exp(v["I2I"]))), "ii": np.full(n, v["I2I"]), "id": np.full(n, -np.inf),
        "dm": np.full(n, v["D2M"]), "dd": np.full(n, np.log(1 - np.exp(v["D2M"]))), "di": np.full(n, -np.inf),
    }
    for lo, hi in inserts:
        for i in range(max(lo, 1), min(hi, n - 1)):
            p["mi"][i] = np.logaddexp(v["M2I"], np.log(0.1))
            total = np.logaddexp(np.logaddexp(p["mm"][i], p["md"][i]), p["mi"][i])
            for kind in ("mm", "md", "mi"):
                p[kind][i] -= total
    p["mm"][0] = p["md"][0] = p["mi"][0] = np.log(1 / 3)
    p["mm"][-1], p["mi"][-1], p["md"][-1] = v["M2End"], np.log(1 - np.exp(v["M2End"])), -np.inf
    p["dm"][0] = p["dd"][0] = p["dd"][-1] = -np.inf
    p["dm"][-1] = 0.0
    p["match"] = np.log(emission + 1e-16)
    p["insert"] = np.full((n, 4), np.log(0.25))
    return p


def smoothed_emission(frequency: np.ndarray, pseudocount: float) -> np.ndarray:
    e = frequency + np.exp(pseudocount)
    return e / e.sum(1, keepdims=True)
