"""Alignment end to end: chunk graphs, merge tree, consensus, training, decoding, assembly.

Graphs are tables of rows of four kinds:

node: graph_id, a (its number), weight, headtail, coord, fragment, b (1 on the backbone)
edge: graph_id, a and b (from, to), weight
path: graph_id, a (seq_ord), path (the sequence's nodes); chunk graphs only
map:  graph_id, a (a graph of the level below), path (the node here of each of its nodes)

Merging reads and writes nodes and edges only; sequences meet a merged graph through the composed maps.  Steps that need a
graph in order are grouped maps keyed by graph (and parameter set, and slice of sequences); all that follows decoding is
relational.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions.symbols import log_sum_exp
from seqloom.operators import alignment, hmm
from seqloom.operators.build import Builder, built, diagonal_blocks, merged_graphs
from seqloom.operators.consensus import BASES, GRID, Consensus, consensus, smoothed_emission, start_parameters, symbol_graph
from seqloom.operators.kernels import heaviest_chain, longest_rise, rising_choice
from seqloom.operators.profile import chunks

GRAPH = "graph_id int, kind string, a long, b long, weight long, headtail int, coord int, fragment string, path array<int>"
COLUMNS = [f.split()[0] for f in GRAPH.split(", ")]
#: Sequences that a graph should stand for before they are decoded on it; sequences that one task traces; chunks from which on
#: the alignment isn't drawn unless asked for.
DECODED_TOGETHER, SLICE, DRAWN_BELOW = 80_000, 2000, 400


def graph_rows(g: Builder, graph_id: int) -> pd.DataFrame:
    """Nodes and edges of a graph as rows."""
    n, backbone = len(g.fragment), set(g.backbone)
    nodes = pd.DataFrame({"kind": "node", "a": range(n), "b": [int(v in backbone) for v in range(n)], "weight": g.weight, "headtail": g.headtail, "coord": g.level, "fragment": g.fragment})
    edges = pd.DataFrame([("edge", a, b, w) for (a, b), w in g.edges.items()], columns=["kind", "a", "b", "weight"])
    return pd.concat([nodes, edges], ignore_index=True).assign(graph_id=graph_id, path=None)[COLUMNS]


def list_rows(kind: str, graph_id: int, lists: list[tuple[int, list[int]]]) -> pd.DataFrame:
    rows = pd.DataFrame({"a": [a for a, _ in lists], "path": [p for _, p in lists]})
    return rows.assign(graph_id=graph_id, kind=kind, b=None, weight=None, headtail=None, coord=None, fragment=None)[COLUMNS]


def graph_of(rows: pd.DataFrame) -> Builder:
    """The graph of its node and edge rows."""
    nodes, edges = rows[rows["kind"] == "node"].sort_values("a"), rows[rows["kind"] == "edge"].sort_values(["a", "b"])
    g = Builder(len(nodes["fragment"].iloc[0]))
    for f, h, c in zip(nodes["fragment"], nodes["headtail"].astype(int), nodes["coord"].astype(int), strict=True):
        g.node(f, h, c)
    g.weight = nodes["weight"].astype(int).tolist()
    g.backbone = nodes.loc[nodes["b"] == 1].sort_values("coord")["a"].astype(int).tolist()
    g.edges.update(zip(zip(edges["a"].astype(int), edges["b"].astype(int), strict=True), edges["weight"].astype(int), strict=True))
    return g


def shapes(graphs: DataFrame) -> DataFrame:
    return graphs.where("kind IN ('node', 'edge')")


def build_graphs(seqs: DataFrame, k: int, chunk: int) -> DataFrame:
    """A graph for each chunk of sequences, with their paths; sequences shorter than k have no place in it."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows["seq"].str.len() >= k].sort_values("seq_idx")
        if rows.empty:
            return pd.DataFrame(columns=COLUMNS)
        g, graph_id = built(rows["seq"].tolist(), k), int(rows["chunk_id"].iloc[0])
        return pd.concat([graph_rows(g, graph_id), list_rows("path", graph_id, list(zip(rows["seq_ord"].tolist(), g.paths, strict=True)))])

    return chunks(seqs, chunk).groupBy("chunk_id").applyInPandas(build, GRAPH)


def merge_level(graphs: DataFrame) -> DataFrame:
    """The graphs of the next level, one from each pair of neighbours, with a map from each of the pair."""

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        found = [(int(i), graph_of(part)) for i, part in rows.groupby("graph_id")]
        parent = (found[0][0] + 1) // 2
        if len(found) == 2:
            g, *maps = merged_graphs(found[0][1], found[1][1])
        else:
            g, maps = found[0][1], [list(range(len(found[0][1].fragment)))]
        return pd.concat([graph_rows(g, parent), list_rows("map", parent, [(i, m) for (i, _), m in zip(found, maps, strict=True)])])

    return shapes(graphs).groupBy(F.floor((F.col("graph_id") + 1) / 2)).applyInPandas(merge, GRAPH)


def merge_levels(graphs: DataFrame, write) -> list[DataFrame]:
    """All levels, from the chunk graphs up to one graph.  ``write`` puts each level into shared storage."""
    levels = [graphs]
    top = graphs.agg(F.max("graph_id")).first()[0] or 1
    while top > 1:
        levels.append(write(merge_level(levels[-1])))
        top = (top + 1) // 2
    return levels


def merge_graphs(graphs: DataFrame, write) -> DataFrame:
    """One graph from all."""
    return merge_levels(graphs, write)[-1]


def decoding_level(chunk: int, levels: int, least: int = DECODED_TOGETHER) -> int:
    """The lowest level whose graphs stand for ``least`` sequences, else the top."""
    return next((i for i in range(levels) if chunk << i >= least), levels - 1)


def paths_at(levels: list[DataFrame], level: int) -> DataFrame:
    """graph_id, seq_ord, path of every sequence on the graphs of a level, through the composed maps."""
    paths = levels[0].where("kind = 'path'").select("graph_id", F.col("a").alias("seq_ord"), "path")
    step = None
    for graphs in levels[1 : level + 1]:
        up = graphs.where("kind = 'map'").select(F.col("a").cast("int").alias("below"), F.col("graph_id").alias("above"), F.col("path").alias("up"))
        if step is None:
            step = up.select(F.col("below").alias("chunk"), "above", F.col("up").alias("map"))
        else:
            moved = F.transform("map", lambda v: F.element_at("up", v + 1))
            step = step.withColumnRenamed("above", "below").join(up, "below").select("chunk", "above", moved.alias("map"))
    if step is None:
        return paths
    moved = F.transform("path", lambda v: F.element_at("map", v + 1))
    return paths.join(step, F.col("graph_id") == F.col("chunk")).select(F.col("above").alias("graph_id"), "seq_ord", moved.alias("path"))


def mapped_reference(g: Builder, at: list[int], reference: str) -> list[int | None]:
    """The symbol node of each position of a reference sequence, through the fragments of the graph; none for the first."""
    windows = [reference[i : i + g.k] for i in range(len(reference) - g.k + 1)]
    near = [g.index.get((0, w), []) for w in windows]
    path: list[int | None] = [max(c, key=lambda v: (g.weight[v], -v)) if c else None for c in near]
    blocks = diagonal_blocks([None if v is None else g.level[v] for v in path], [0 if v is None else g.weight[v] for v in path])
    for b in heaviest_chain([(v0, v1, w) for v0, v1, _, _, w in blocks]):
        path[blocks[b][2] : blocks[b][3] + 1] = [None] * (blocks[b][3] + 1 - blocks[b][2])
    i, n = 0, len(path)
    while i < n:
        j = i
        while j < n and path[j] is None:
            j += 1
        if j > i:
            lo = g.level[path[i - 1]] if i else 0
            hi = g.level[path[j]] if j < n else max(g.level, default=0) + 1
            slots = [[(v, g.level[v], g.weight[v]) for v in near[x] if lo < g.level[v] < hi] for x in range(i, j)]
            for x, v in enumerate(rising_choice(slots)):
                path[i + x] = None if v < 0 else v
        i = j + 1
    return [None] * min(g.k - 1, len(reference)) + [None if v is None else at[v] for v in path]


COUNTS = "param_id int, kind string, pos int, symbol string, logp double"


def over_grid(graphs: DataFrame) -> DataFrame:
    return shapes(graphs).withColumn("param_id", F.explode(F.sequence(F.lit(0), F.lit(len(GRID) - 1))))


def expected_counts(graphs: DataFrame) -> DataFrame:
    """param_id, kind, pos, symbol, logp: one pass over each graph and parameter set of the grid, counts summed over graphs.

    The kinds freq (share of a base in a column) and hot (from pos to symbol inserts are frequent) carry the start values on.
    """

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        param = int(rows["param_id"].iloc[0])
        share, add = GRID[param]
        g, _ = symbol_graph(graph_of(rows))
        ref = consensus(g, share)
        model = hmm.Model(g, ref, start_parameters(smoothed_emission(ref.frequency, add), ref.inserts), clean_only=True)
        found = model.expectations()
        found += [("freq", j, b, float(np.log(max(x, 1e-300)))) for j, row in enumerate(ref.frequency) for b, x in zip(BASES, row, strict=True)]
        found += [("hot", lo, str(hi), 0.0) for lo, hi in ref.inserts]
        return pd.DataFrame(found, columns=["kind", "pos", "symbol", "logp"]).assign(param_id=param)[["param_id", "kind", "pos", "symbol", "logp"]]

    counts = over_grid(graphs).groupBy("graph_id", "param_id").applyInPandas(count, COUNTS)
    return log_sum_exp(counts, ["param_id", "kind", "pos", "symbol"], "logp")


def trained(counts: DataFrame) -> DataFrame:
    """param_id, kind, pos, symbol, logp: the parameters after one round, for each parameter set; as long as the profile."""

    def maximise(rows: pd.DataFrame) -> pd.DataFrame:
        param = int(rows["param_id"].iloc[0])
        add = GRID[param][1]
        held = {(k, int(j), s): float(x) for k, j, s, x in zip(rows["kind"], rows["pos"], rows["symbol"], rows["logp"], strict=True)}
        length = 1 + max(j for k, j, _ in held if k == "freq")
        frequency = np.array([[np.exp(held["freq", j, b]) for b in BASES] for j in range(length)])
        start = start_parameters(smoothed_emission(frequency, add), sorted((j, int(s)) for k, j, s in held if k == "hot"))
        new = hmm.re_estimated(start, held, add)
        out = [(k, j, "" if x.ndim == 1 else BASES[i], float(v)) for k, x in new.items() for (j, i), v in np.ndenumerate(x.reshape(len(x), -1))]
        return pd.DataFrame(out, columns=["kind", "pos", "symbol", "logp"]).assign(param_id=param)[["param_id", "kind", "pos", "symbol", "logp"]]

    return counts.groupBy("param_id").applyInPandas(maximise, COUNTS)


def models_of(parameters: DataFrame) -> dict[int, tuple[str, dict[str, np.ndarray]]]:
    """Reference sequence (likeliest symbols) and parameters of each set."""
    rows, out = parameters.toPandas().sort_values(["pos"]), {}  # as long as the profile
    for param, part in rows.groupby("param_id"):
        p = {}
        for kind, x in part.groupby("kind"):
            p[kind] = x["logp"].to_numpy() if (x["symbol"] == "").all() else np.stack([x.loc[x["symbol"] == b, "logp"].to_numpy() for b in BASES], 1)
        out[int(param)] = "".join(BASES[i] for i in p["match"].argmax(1)), p
    return out


STATES = "param_id int, seq_ord long, pos int, state int, run int, symbol string"


def decoded(graphs: DataFrame, paths: DataFrame, models: dict[int, tuple[str, dict]]) -> DataFrame:
    """param_id, seq_ord, pos, state, run, symbol of every symbol; models are as long as the profile, not the data."""

    def decode(rows: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or some.empty:
            return pd.DataFrame(columns=[f.split()[0] for f in STATES.split(", ")])
        param = int(some["param_id"].iloc[0])
        reference, p = models[param]
        g = graph_of(rows)
        g.paths = [list(map(int, x)) for x in some["path"]]
        symbols, at = symbol_graph(g)
        # positions whose nodes don't follow one another in the graph of single symbols would leave nodes without a window
        nodes = mapped_reference(g, at, reference)
        rise = longest_rise([None if v is None else symbols.level[v] for v in nodes])
        ref = Consensus([None if c is None else v for v, c in zip(nodes, rise, strict=True)], p["match"], [])
        model = hmm.Model(symbols, ref, p)
        best = model.viterbi()
        out = [
            (param, seq, j, state, run, symbols.fragment[v])
            for seq, path in zip(some["seq_ord"].tolist(), symbols.paths, strict=True)
            for v, (state, j, run) in zip(path, model.traced(best, path), strict=True)
        ]
        return pd.DataFrame(out, columns=[f.split()[0] for f in STATES.split(", ")])

    grid, key = F.explode(F.sequence(F.lit(0), F.lit(len(models) - 1))), ["graph_id", "param_id", "slice"]
    sizes = paths.groupBy("graph_id").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("slices"))  # one row for each graph
    some = paths.join(sizes, "graph_id").withColumn("slice", F.pmod(F.xxhash64("seq_ord"), F.col("slices")).cast("int"))
    some = some.select(F.col("graph_id").alias("graph_id"), "slice", grid.alias("param_id"), "seq_ord", "path")
    each = shapes(graphs).join(sizes, "graph_id").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    each = each.select(F.col("graph_id").alias("graph_id"), "slice", grid.alias("param_id"), *COLUMNS[1:])
    return each.groupBy(*key).cogroup(some.groupBy(*key)).applyInPandas(decode, STATES)


def assembled(states: DataFrame, length: int) -> tuple[DataFrame, int]:
    """cells (row, col, sym) of one parameter set's states, and the number of columns."""
    spark = states.sparkSession
    inserts = states.where("state = 2").groupBy("pos").agg((F.max("run") + 1).alias("n"))
    slots = spark.range(length + 1).select(F.col("id").cast("int").alias("pos")).join(inserts, "pos", "left")
    layout = alignment.column_layout(slots.select("pos", F.coalesce("n", F.lit(0)).alias("n_insert")))
    cells = alignment.place_cells(states.withColumnRenamed("seq_ord", "row"), layout)
    total = layout.agg(F.sum(F.col("n_insert") + 1)).first()[0] - 1  # no match column after the last inserts
    return cells, int(total)


@dataclass
class Aligned:
    """An alignment: the report of all parameter sets, cells (row, col, sym; row is the seq_ord) of that with least entropy, and
    the graphs of all levels, consensus (start frequencies and insert ranges) and parameters that led to it."""

    report: DataFrame
    cells: DataFrame
    n_cols: int
    n_rows: int
    n_chunks: int
    levels: list[DataFrame]
    consensus: DataFrame
    parameters: DataFrame

    def counts(self) -> DataFrame:
        return alignment.symbol_counts(self.cells, self.n_rows)

    def named(self) -> DataFrame:
        """number (from 0, in the order of the input) and row of each sequence."""
        rows = chunks(self.cells.select(F.col("row").alias("seq_ord")).distinct(), 1)
        return rows.select((F.col("chunk_id") - 1).cast("long").alias("number"), F.col("seq_ord").alias("row"))

    def columns(self) -> DataFrame:
        """Sparse columns over the rows' numbers."""
        cells = self.cells.join(self.named(), "row").select(F.col("number").alias("row"), "col", "sym")
        return alignment.sparse_columns(cells, alignment.majority_mains(self.counts()), self.n_rows)

    def rows(self, reference: bool = False) -> DataFrame:
        """row, aligned in the order of the input; with ``reference`` a first row (null) of each column's main symbol."""
        drawn = alignment.rendered_rows(self.cells, self.cells.select("row").distinct(), self.n_cols)
        if reference:
            drawn = drawn.unionByName(alignment.reference_row(alignment.majority_mains(self.counts()), self.n_cols))
        return drawn.orderBy(F.col("row").asc_nulls_first())


def aligned(seqs: DataFrame, k: int, chunk: int, write) -> Aligned:
    """Aligns sequences (seq_ord, seq).  ``write`` puts a DataFrame into shared storage and reads it back."""
    levels = merge_levels(write(build_graphs(seqs, k, chunk)), write)
    n_chunks = levels[0].select("graph_id").distinct().count()
    counts = write(expected_counts(levels[-1]))
    parameters = write(trained(counts))
    models = models_of(parameters)
    level = decoding_level(chunk, len(levels))
    paths = write(paths_at(levels, level))
    states = write(decoded(levels[level], paths, models))
    n_rows = paths.count()
    reports, drawn = None, {}
    for param, (reference, _) in models.items():
        cells, n_cols = assembled(states.where(F.col("param_id") == param), len(reference))
        cells = write(cells)
        drawn[param] = cells, n_cols
        scores = alignment.column_scores(alignment.base_counts(alignment.symbol_counts(cells, n_rows)))
        row = alignment.alignment_score(scores).select(F.lit(param).alias("param_id"), "sp", "entropy", F.lit(n_cols).alias("length"))
        reports = row if reports is None else reports.unionByName(row)
    report = write(alignment.ranked_report(reports))
    best = report.where("best_entropy").first()["param_id"]
    return Aligned(report, *drawn[best], n_rows, n_chunks, levels, counts.where("kind IN ('freq', 'hot')"), parameters)
