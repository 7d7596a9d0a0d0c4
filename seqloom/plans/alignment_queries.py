"""Queries over alignments and models: scores, layout, sparse columns, consensus, parameters, decoding."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.symbols import ALIGNED, STANDS_FOR
from seqloom.operators import alignment, consensus, graph, hmm
from seqloom.operators.build import Builder
from seqloom.operators.profile import sequences
from seqloom.plans import align
from seqloom.plans.profile_queries import R, S, reads, seqs, sequence_expression, table
from seqloom.plans.storage import written

ADD, INSERTS = -3.0, [(10, 20), (100, 130)]
FRAGMENT, READ_CHUNK = 8, 20


def counts_of(spark, sf_dir) -> DataFrame:
    """Symbol counts of the alignment that puts every sequence's symbols in the column of their position."""
    rows = seqs(spark, sf_dir)
    return alignment.symbol_counts(alignment.naive_cells(rows), int(rows.count()))


def bases_of(spark, sf_dir) -> DataFrame:
    return alignment.base_counts(counts_of(spark, sf_dir))


def column_counts(spark, sf_dir):
    rows = bases_of(spark, sf_dir)
    return rows.select(F.col("col").cast("long").alias("col"), *[F.round(f"n_{b}", 6).alias(f"n_{b}") for b in ("a", "t", "c", "g", "gap")])


def scores_of(spark, sf_dir) -> DataFrame:
    return alignment.column_scores(bases_of(spark, sf_dir))


def sp_score(spark, sf_dir):
    rows = alignment.alignment_score(scores_of(spark, sf_dir))
    return rows.select(F.col("n_cols").cast("long").alias("n_cols"), "pos", "neg", F.round("sp", 9).alias("sp"))


def entropy(spark, sf_dir):
    rows = alignment.alignment_score(scores_of(spark, sf_dir))
    return rows.select(F.round("entropy", 5).alias("entropy"), F.round("core_entropy", 6).alias("core_entropy"))


def alignment_score(spark, sf_dir):
    rows = alignment.alignment_score(scores_of(spark, sf_dir))
    return rows.select(F.round("sp", 9).alias("sp"), F.round("entropy", 5).alias("entropy"))


def majority_rebase(spark, sf_dir):
    return alignment.majority_mains(counts_of(spark, sf_dir)).select(F.col("col").cast("long").alias("col"), F.col("main").cast("long").alias("main"))


def profile_columns(spark, sf_dir):
    rows = consensus.profile_columns(bases_of(spark, sf_dir))
    return rows.select(F.col("pos").cast("long").alias("pos"), "base", F.round("prob", 9).alias("prob"))


def consensus_seq(spark, sf_dir):
    return consensus.consensus_rows(consensus.profile_columns(bases_of(spark, sf_dir))).select(F.col("pos").cast("long").alias("pos"), "base")


def emission_smooth(spark, sf_dir):
    rows = consensus.smoothed(consensus.profile_columns(bases_of(spark, sf_dir)), ADD)
    return rows.select(F.col("pos").cast("long").alias("pos"), "base", F.round("prob", 9).alias("prob"))


def degenerate_emission(spark, sf_dir):
    rows = consensus.smoothed(consensus.profile_columns(bases_of(spark, sf_dir)), ADD).withColumn("logp", F.log("prob"))
    return consensus.degenerate_emissions(rows).select(F.col("pos").cast("long").alias("pos"), "symbol", F.round("logp", 8).alias("logp"))


def hmm_init(spark, sf_dir):
    """Start values of a profile as long as the longest text."""
    length = int(reads(spark, sf_dir).agg(F.max(F.length("seq"))).first()[0])
    rows = consensus.start_transitions(length, spark, INSERTS)
    return rows.select(F.col("pos").cast("long").alias("pos"), "kind", F.round(F.greatest("logp", F.lit(-1e9)), 8).alias("logp"))


def hyper_grid(spark, sf_dir):
    """Of each parameter set the strong edges among all texts' symbols, and the likeliest base's smoothed share in the first column."""
    rows = reads(spark, sf_dir).withColumn("graph_id", F.lit(1))
    nodes, edges, bases = graph.chain_nodes(rows, 1), graph.chain_edges(rows, 1), alignment.base_counts(alignment.symbol_counts(alignment.naive_cells(rows), int(rows.count())))
    found = None
    for param, (share, add) in enumerate(consensus.GRID):
        strong = graph.stem_edges(nodes, edges, share).agg(F.count(F.lit(1)).alias("n_edges"), F.sum("weight").alias("weight"))
        top = consensus.smoothed(consensus.profile_columns(bases.where("col = 0")), add).agg(F.round(F.max("prob"), 9).alias("top"))
        row = strong.select(F.lit(param).cast("long").alias("param_id"), F.lit(share).alias("stem"), F.lit(add).alias("pseudocount"), "n_edges", "weight")
        row = row.join(top.withColumn("param_id", F.lit(param).cast("long")), "param_id")
        found = row if found is None else found.unionByName(row)
    return found


def slots_of(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), (F.col("p_size") % 3).cast("long").alias("n_insert"))


def column_layout(spark, sf_dir):
    rows = alignment.column_layout(slots_of(spark, sf_dir))
    return rows.select("pos", "n_insert", F.col("first_insert").cast("long").alias("first_insert"), F.col("match_col").cast("long").alias("match_col"))


def cell_place(spark, sf_dir):
    layout = alignment.column_layout(slots_of(spark, sf_dir))
    line = table(spark, sf_dir, "lineitem")
    states = line.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row"), F.col("l_partkey").alias("pos"), F.when(F.floor("l_quantity") % 2 == 0, 0).otherwise(2).alias("state"),
        F.lit(0).alias("run"), F.substring(F.lit("ATCGRXN"), F.col("l_linenumber"), F.lit(1)).alias("symbol"),
    )
    states = states.join(layout.where("n_insert = 0").select("pos"), "pos", "left_anti").unionByName(states.where("state = 0").join(layout.where("n_insert = 0").select("pos"), "pos", "left_semi"))
    rows = alignment.place_cells(states, layout)
    return rows.select("row", F.col("col").cast("long").alias("col"), F.col("sym").cast("long").alias("sym"))


def read_cells(spark, sf_dir) -> tuple[DataFrame, DataFrame, int]:
    rows = written(reads(spark, sf_dir))
    cells = alignment.naive_cells(rows)
    return rows, cells, rows.count()


def sparse_encode(spark, sf_dir):
    _, cells, n = read_cells(spark, sf_dir)
    mains = alignment.majority_mains(alignment.symbol_counts(cells, n).where("sym <> 0"))
    rows = alignment.sparse_columns(cells, mains).groupBy("col", "main").agg(F.array_sort(F.collect_list(F.struct("sym", "piece", "rows"))).alias("minors"))
    listed = F.filter("minors", lambda m: m["rows"].isNotNull())
    text = F.array_join(F.transform(listed, lambda m: F.concat(m["sym"].cast("string"), F.lit(":"), F.array_join(m["rows"], ","))), ";")
    return rows.select(F.col("col").cast("long").alias("col"), F.col("main").cast("long").alias("main"), text.alias("minors"))


def sparse_round_trip(spark, sf_dir):
    """Symbols of each column after the alignment went through sparse columns, which were based anew."""
    rows, cells, n = read_cells(spark, sf_dir)
    numbers = rows.select(F.col("seq_ord").alias("row"), (F.row_number().over(Window.orderBy("seq_ord")) - 1).cast("long").alias("number"))  # one row for each text
    cells = cells.join(numbers, "row").select(F.col("number").alias("row"), "col", "sym")
    first = alignment.sparse_columns(cells, cells.groupBy("col").agg(F.min("sym").alias("main")), n, step=16)
    back = alignment.cells_of(alignment.rebased(first, n, step=16), n, step=16)
    return back.groupBy(F.col("col").cast("long").alias("col"), F.col("sym").cast("long").alias("sym")).agg(F.count(F.lit(1)).alias("n"), F.sum("row").alias("rows"))


def merged_alignment(spark, sf_dir):
    """Alignments of five suppliers' lines to one profile, one below the other."""
    line = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 5).alias("part"), F.col("l_partkey").alias("pos"), F.col("l_linenumber").cast("long").alias("line"), "l_orderkey")
    parts = line.groupBy("part", "pos").agg((F.max("line") % 4).cast("long").alias("n_insert"))
    own = parts.withColumn("match_col", F.sum(F.col("n_insert") + 1).over(Window.partitionBy("part").orderBy("pos")) - 1)
    cells = line.join(own, ["part", "pos"]).where("line <= n_insert + 1").select("part", F.col("l_orderkey").alias("row"), (F.col("match_col") - F.col("line") + 1).alias("col"), F.col("line").alias("sym"))
    sizes = line.groupBy("part").agg(F.max("l_orderkey").alias("n_rows"))
    return alignment.merged_cells(cells, parts, sizes).groupBy("col", "sym").agg(F.count(F.lit(1)).alias("n"), F.sum("row").alias("rows"))


def fasta_render(spark, sf_dir):
    rows, cells, _ = read_cells(spark, sf_dir)
    n_cols = int(rows.agg(F.max(F.length("seq"))).first()[0] or 0)
    return alignment.rendered_rows(cells, rows.select(F.col("seq_ord").alias("row")), n_cols)


def alignment_merge(spark, sf_dir):
    parts = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 5).alias("part"), F.col("l_partkey").alias("pos"))
    rows = alignment.merge_alignments(parts.agg((F.max("l_linenumber") % 4).cast("long").alias("n_insert")))
    return rows.select("part", "pos", "own", "padding", F.col("first_own").cast("long").alias("first_own"), F.col("match_col").cast("long").alias("match_col"))


def row_offsets(spark, sf_dir):
    parts = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("part")).agg(F.count(F.lit(1)).alias("n_rows"))
    return alignment.row_offsets(parts)


def report_rank(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("param_id"))
    scores = rows.agg(F.round(F.max("c_acctbal"), 2).alias("sp"), F.round(F.min("c_acctbal"), 2).alias("entropy"), F.count(F.lit(1)).alias("length"))
    return alignment.ranked_report(scores)


# ---- models over the graph of all benchmark sequences


def levels_of(spark, sf_dir) -> list[DataFrame]:
    return align.merge_levels(written(align.build_graphs(reads(spark, sf_dir), FRAGMENT, READ_CHUNK)), written)


def hmm_forward(spark, sf_dir):
    """ln P of the graph by the forward and by the backward pass, for each parameter set."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        param = int(rows["param_id"].iloc[0])
        g, _ = consensus.symbol_graph(align.graph_of(rows))
        ref = consensus.consensus(g, consensus.GRID[param][0])
        emission = consensus.smoothed_emission(ref.frequency, consensus.GRID[param][1])
        model = hmm.Model(g, ref, consensus.start_parameters(emission, ref.inserts))
        return pd.DataFrame({"param_id": [param], "forward": [model.forward()[1]], "backward": [model.backward()[1]]})

    grid = align.over_grid(levels_of(spark, sf_dir)[-1])
    rows = grid.groupBy("graph_id", "param_id").applyInPandas(run, "param_id long, forward double, backward double")
    return rows.select("param_id", F.round("forward", 6).alias("forward"), F.round("backward", 6).alias("backward"))


def hmm_em(spark, sf_dir):
    """Expected counts of one round, as probabilities summed over positions."""
    rows = align.expected_counts(levels_of(spark, sf_dir)[-1]).where("kind NOT IN ('freq', 'hot')")
    rows = rows.groupBy(F.col("param_id").cast("long").alias("param_id"), "kind", "symbol")
    return rows.agg(F.round(F.sum(F.exp("logp")), 6).alias("expected"))


def hmm_parameters(spark, sf_dir):
    """Parameters after one round, by position."""
    rows = align.trained(align.expected_counts(levels_of(spark, sf_dir)[-1]))
    return rows.select(F.col("param_id").cast("long").alias("param_id"), "kind", F.col("pos").cast("long").alias("pos"), "symbol", F.round(F.greatest("logp", F.lit(-1e9)), 6).alias("logp"))


def viterbi(spark, sf_dir):
    """Hidden state of every symbol."""
    levels = levels_of(spark, sf_dir)
    models = align.models_of(align.trained(align.expected_counts(levels[-1])))
    level = align.decoding_level(READ_CHUNK, len(levels))
    rows = align.decoded(levels[level], align.paths_at(levels, level), models)
    return rows.select(*[F.col(c).cast("long").alias(c) for c in ("param_id", "seq_ord", "pos", "state", "run")], "symbol")


def graph_paths(spark, sf_dir):
    """Length, and weight of the first and last node, of every sequence's path on the final graph: nothing is lost on the way up."""
    levels = levels_of(spark, sf_dir)
    paths = align.paths_at(levels, len(levels) - 1)
    nodes = levels[-1].where("kind = 'node'").select(F.col("a").cast("int").alias("node"), "fragment")
    steps = paths.select("seq_ord", F.posexplode("path").alias("pos", "node")).join(nodes, "node")
    spelt = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "fragment"))), lambda x: F.when(x["pos"] == 0, x["fragment"]).otherwise(F.substring(x["fragment"], FRAGMENT, 1))), "")
    return steps.groupBy("seq_ord").agg(F.count(F.lit(1)).alias("n"), F.md5(spelt.cast("binary")).alias("md5"))


def align_end_to_end(spark, sf_dir):
    return align.aligned(reads(spark, sf_dir), FRAGMENT, READ_CHUNK, written).rows()


def align_letters(spark, sf_dir):
    """The aligned rows without their gaps are the sequences."""
    rows = align.aligned(reads(spark, sf_dir), FRAGMENT, READ_CHUNK, written).rows()
    whole = F.translate("aligned", "-", "")
    return rows.select("row", F.length(whole).cast("long").alias("len"), F.md5(whole.cast("binary")).alias("md5"))


def align_report(spark, sf_dir):
    rows = align.aligned(reads(spark, sf_dir), FRAGMENT, READ_CHUNK, written).report
    return rows.select(F.col("param_id").cast("long").alias("param_id"), F.round("sp", 6).alias("sp"), F.round("entropy", 5).alias("entropy"), F.col("length").cast("long").alias("length"), "best_sp", "best_entropy")


# ---- models small enough to list all their state paths: a profile of DEPTH columns against every part name

DEPTH = 4
#: Start values that make no two state paths of a name equally likely.
UNLIKE = {"M2D": -2.0, "M2I": -5.0, "I2I": -0.9, "D2M": -0.6, "M2End": -0.4}


def names_of(spark, sf_dir) -> DataFrame:
    return sequences(table(spark, sf_dir, "part").select("p_name").distinct(), "p_name", "p_name")


def over_names(spark, sf_dir, kernel, schema: str) -> DataFrame:
    """kernel(name, model) -> rows, for the graph of each name and the smoothed profile of all names' first columns."""
    names = names_of(spark, sf_dir)
    cells = names.select("seq_ord", F.posexplode(F.split("seq", "")).alias("col", "symbol")).where((F.col("col") < DEPTH) & (F.col("symbol") != ""))
    counts = cells.groupBy("col").agg(*[F.count_if(F.col("symbol") == b).cast("double").alias(f"n_{b.lower()}") for b in consensus.BASES])
    rows = consensus.smoothed(consensus.profile_columns(counts), ADD).collect()  # DEPTH columns of four
    emission = np.zeros((DEPTH, 4))
    for r in rows:
        emission[r["pos"], consensus.BASES.index(r["base"])] = r["prob"]
    columns = [f.split()[0] for f in schema.split(", ")]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for name, seq in zip(rows["seq_ord"], rows["seq"], strict=True):
            g = Builder(1)
            g.add(seq)
            out += kernel(name, hmm.Model(g, consensus.Consensus([None] * DEPTH, emission, []), consensus.start_parameters(emission, values=UNLIKE)))
        return pd.DataFrame(out, columns=columns)

    return names.where("seq <> ''").groupBy("seq_ord").applyInPandas(run, schema)


def hmm_exact(spark, sf_dir):
    """ln P of each name by the forward and the backward pass, and of its best state path."""

    def kernel(name, model):
        values, end = model.viterbi(), model.g.paths[0][-1]
        return [(name, model.forward()[1], model.backward()[1], model.finish(*model.full(end, values[end]), np.maximum))]

    rows = over_names(spark, sf_dir, kernel, "name string, forward double, backward double, best double")
    return rows.select("name", *[F.round(c, 8).alias(c) for c in ("forward", "backward", "best")])


def hmm_exact_counts(spark, sf_dir):
    """Expected counts of all names."""

    def kernel(name, model):
        return [(k, j, s, math.exp(x)) for k, j, s, x in model.expectations()]

    rows = over_names(spark, sf_dir, kernel, "kind string, pos long, symbol string, expected double").groupBy("kind", "pos", "symbol")
    return rows.agg(F.round(F.sum("expected"), 7).alias("expected")).where("expected > 0")


def viterbi_exact(spark, sf_dir):
    """State of each symbol on the best path: 0 match, 2 insert; its column; inserts still to come there."""

    def kernel(name, model):
        path = model.g.paths[0]
        return [(name, i, state, j, run) for i, (state, j, run) in enumerate(model.traced(model.viterbi(), path))]

    return over_names(spark, sf_dir, kernel, "name string, site long, state long, pos long, run long")


QUERIES = {
    f.__name__: f
    for f in (
        hmm_exact, hmm_exact_counts, viterbi_exact, column_counts, sp_score, entropy, alignment_score, majority_rebase, profile_columns, consensus_seq, emission_smooth, degenerate_emission, hmm_init, hyper_grid,
        column_layout, cell_place, sparse_encode, sparse_round_trip, merged_alignment, fasta_render, alignment_merge, row_offsets, report_rank, hmm_forward, hmm_em, hmm_parameters, viterbi, graph_paths, align_end_to_end, align_letters, align_report,
    )
}

CELLS = "c AS (SELECT seq_ord AS row, unnest(range(0, length(seq))) AS col, unnest(string_split(seq, '')[1:length(seq)]) AS symbol FROM s WHERE seq <> '')"
COUNTS = f"""{S}, {CELLS}, k AS (SELECT col, count_if(symbol = 'A')::double AS n_a, count_if(symbol = 'T')::double AS n_t, count_if(symbol = 'C')::double AS n_c,
  count_if(symbol = 'G')::double AS n_g, ((SELECT count(*) FROM s) - count(*))::double AS n_gap FROM c GROUP BY col)"""
SCORES = f"""{COUNTS}, m AS (SELECT *, n_a + n_t + n_c + n_g AS held, n_a * n_a + n_t * n_t + n_c * n_c + n_g * n_g AS sq, n_a + n_t + n_c + n_g + n_gap AS n FROM k),
x AS (SELECT *, (sq - held) / 2 AS pos, -(held * held - sq) / 2 - 2 * held * n_gap AS neg,
  list_sum(list_transform([n_a, n_t, n_c, n_g, n_gap], lambda v: CASE WHEN v > 0 THEN -(v / n) * ln(v / n) ELSE 0 END)) AS h FROM m),
z AS (SELECT count(*) AS n_cols, sum(pos) AS pos, sum(neg) AS neg, max(n) AS n, sum(h) AS h, avg(CASE WHEN n_gap / n < 0.7 THEN h END) AS core FROM x)"""
SP = "CASE WHEN n < 2 THEN 0 ELSE 2 * (pos + neg) / (n * (n - 1) * n_cols) END"
PROFILE = f"""{COUNTS}, p AS (SELECT col AS pos, unnest(['A', 'T', 'C', 'G']) AS base, unnest([n_a, n_t, n_c, n_g]) / (n_a + n_t + n_c + n_g) AS prob FROM k)"""
SMOOTH = f"{PROFILE}, h AS (SELECT pos, base, (prob + exp({ADD})) / sum(prob + exp({ADD})) OVER (PARTITION BY pos) AS prob FROM p)"
SLOTS = """s AS (SELECT p_partkey AS pos, (p_size % 3)::bigint AS n_insert FROM part),
l AS (SELECT *, coalesce(sum(n_insert + 1) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS first_insert FROM s)"""
STANDS = ", ".join(f"('{s}', '{b}', {len(bases)})" for s, bases in STANDS_FOR.items() for b in bases)


def _hmm_init_sql() -> str:
    hot = " OR ".join(f"pos BETWEEN {a} AND {b - 1}" for a, b in INSERTS)
    mm, mi, md, half, third = "ln(1 - exp(-2) - exp(-5))", "-5.0", "-2.0", "ln(0.5)", "ln(1.0 / 3)"
    hi = "ln(exp(-5) + 0.1)"
    total = f"ln(exp({mm}) + exp({md}) + exp({hi}))"
    inner = {
        "mm": f"CASE WHEN {hot} THEN {mm} - {total} ELSE {mm} END", "md": f"CASE WHEN {hot} THEN {md} - {total} ELSE {md} END",
        "mi": f"CASE WHEN {hot} THEN {hi} - {total} ELSE {mi} END", "im": half, "id": "-1e9", "ii": half, "dm": half, "dd": half, "di": "-1e9",
    }
    first = {"mm": third, "md": third, "mi": third, "dm": "-1e9", "dd": "-1e9"}
    last = {"mm": half, "mi": half, "md": "-1e9", "dd": "-1e9", "dm": "0.0"}
    rows = " UNION ALL ".join(
        f"SELECT pos, '{k}' AS kind, CASE WHEN pos = 0 THEN {first.get(k, v)} WHEN pos = (SELECT n FROM z) THEN {last.get(k, v)} ELSE {v} END AS logp FROM p" for k, v in inner.items()
    )
    return f"WITH {R}, z AS (SELECT max(length(seq)) AS n FROM s), p AS (SELECT unnest(range(0, n + 1)) AS pos FROM z), a AS ({rows}) SELECT pos, kind, round(logp, 8) AS logp FROM a"


#: All state paths of each name: logarithm of the probability, and the steps (state, column, letters read before it).
PATHS = f"""s AS (SELECT DISTINCT p_name AS name, {sequence_expression("p_name")} AS seq FROM part),
c AS (SELECT name, unnest(range(0, {DEPTH})) AS pos, seq FROM s),
m AS (SELECT pos, b AS base, avg((substr(seq, pos + 1, 1) = b)::int) AS share FROM c, (SELECT unnest(['A', 'T', 'C', 'G']) AS b) WHERE length(seq) > pos GROUP BY ALL),
f AS (SELECT pos, base, ln((share + exp({ADD})) / sum(share + exp({ADD})) OVER (PARTITION BY pos) + 1e-16) AS lp FROM m),
g(src, dst) AS (VALUES ('S', 'M'), ('S', 'I'), ('S', 'D'), ('M', 'M'), ('M', 'I'), ('M', 'D'), ('I', 'M'), ('I', 'I'), ('D', 'M'), ('D', 'D')),
r AS (
  SELECT name, seq, 'S' AS st, -1 AS j, 0 AS i, 0.0::double AS lp, []::STRUCT(src VARCHAR, st VARCHAR, j INT, i INT)[] AS steps FROM s WHERE seq <> ''
  UNION ALL
  SELECT name, seq, dst, n.j, r.i + (dst <> 'D')::int,
    r.lp + CASE src || dst WHEN 'MM' THEN ln(1 - exp({UNLIKE["M2D"]}) - exp({UNLIKE["M2I"]})) WHEN 'MD' THEN {UNLIKE["M2D"]}
      WHEN 'MI' THEN CASE WHEN n.j = {DEPTH} THEN ln(1 - exp({UNLIKE["M2End"]})) ELSE {UNLIKE["M2I"]} END WHEN 'II' THEN {UNLIKE["I2I"]} WHEN 'IM' THEN ln(1 - exp({UNLIKE["I2I"]}))
      WHEN 'DM' THEN {UNLIKE["D2M"]} WHEN 'DD' THEN ln(1 - exp({UNLIKE["D2M"]})) ELSE ln(1.0 / 3) END + CASE dst WHEN 'M' THEN f.lp WHEN 'I' THEN ln(0.25) ELSE 0 END,
    list_append(steps, {{'src': src, 'st': dst, 'j': n.j, 'i': r.i}})
  FROM r JOIN g ON g.src = r.st, LATERAL (SELECT CASE WHEN r.st = 'I' THEN r.j ELSE r.j + 1 END AS j) n
  LEFT JOIN f ON f.pos = n.j AND f.base = substr(seq, r.i + 1, 1)
  WHERE (dst = 'D' OR r.i < length(seq)) AND (dst = 'I' OR n.j < {DEPTH})),
d AS (SELECT name, seq, steps, lp + CASE st WHEN 'D' THEN 0 WHEN 'M' THEN {UNLIKE["M2End"]} ELSE ln(1 - exp({UNLIKE["I2I"]})) END AS lp FROM r
  WHERE i = length(seq) AND (st IN ('M', 'D') AND j = {DEPTH - 1} OR st = 'I' AND j = {DEPTH})),
w AS (SELECT name, seq, steps, lp, exp(lp - max(lp) OVER n) / sum(exp(lp)) OVER n * exp(max(lp) OVER n) AS p FROM d WINDOW n AS (PARTITION BY name)),
k AS (SELECT name, seq, p, lp, unnest(steps, recursive := true) FROM w)"""

ORACLES = {
    "graph_paths": f"WITH {R} SELECT seq_ord, (length(seq) - {FRAGMENT - 1})::bigint AS n, md5(seq) AS md5 FROM s WHERE length(seq) >= {FRAGMENT}",
    "align_letters": f"WITH {R} SELECT seq_ord AS row, length(seq)::bigint AS len, md5(seq) AS md5 FROM s WHERE length(seq) >= {FRAGMENT}",
    "hmm_exact": f"""WITH RECURSIVE {PATHS}, t AS (SELECT name, ln(sum(exp(lp))) AS total, max(lp) AS best FROM d GROUP BY name)
SELECT name, round(total, 8) AS forward, round(total, 8) AS backward, round(best, 8) AS best FROM t""",
    "hmm_exact_counts": f"""WITH RECURSIVE {PATHS}, a AS (
  SELECT 'emit' AS kind, j, substr(seq, i + 1, 1) AS symbol, p FROM k WHERE st = 'M'
  UNION ALL SELECT 'occ_' || lower(st), j, '', p FROM k WHERE st <> 'D' OR i > 0
  UNION ALL SELECT lower(src || st), j, '', p FROM k WHERE src IN ('M', 'I')
  UNION ALL SELECT 'start', CASE st WHEN 'M' THEN 0 WHEN 'I' THEN 1 ELSE 2 END, '', p FROM k WHERE src = 'S')
SELECT kind, j::bigint AS pos, symbol, round(sum(p), 7) AS expected FROM a GROUP BY kind, j, symbol HAVING round(sum(p), 7) > 0""",
    "viterbi_exact": f"""WITH RECURSIVE {PATHS}, b AS (SELECT name, arg_max(steps, lp) AS steps FROM d GROUP BY name), u AS (SELECT name, unnest(steps, recursive := true) FROM b),
o AS (SELECT name, st, j, i, count(*) OVER (PARTITION BY name, st, j) - row_number() OVER (PARTITION BY name, st, j ORDER BY i) AS run FROM u WHERE st <> 'D')
SELECT name, i::bigint AS site, CASE st WHEN 'M' THEN 0 ELSE 2 END::bigint AS state, j::bigint AS pos, CASE st WHEN 'M' THEN 0 ELSE run END::bigint AS run FROM o""",
    "column_counts": f"WITH {COUNTS} SELECT col, n_a, n_t, n_c, n_g, n_gap FROM k",
    "sp_score": f"WITH {SCORES} SELECT n_cols::bigint AS n_cols, pos, neg, round({SP}, 9) AS sp FROM z",
    "entropy": f"WITH {SCORES} SELECT round(h, 5) AS entropy, round(coalesce(core, 0), 6) AS core_entropy FROM z",
    "alignment_score": f"WITH {SCORES} SELECT round({SP}, 9) AS sp, round(h, 5) AS entropy FROM z",
    "majority_rebase": f"""WITH {COUNTS}, u AS (SELECT col, unnest([0, 1, 2, 3, 4]) AS sym, unnest([n_gap, n_a, n_t, n_c, n_g]) AS n FROM k)
SELECT col, sym::bigint AS main FROM u QUALIFY row_number() OVER (PARTITION BY col ORDER BY n DESC, sym) = 1""",
    "profile_columns": f"WITH {PROFILE} SELECT pos, base, round(prob, 9) AS prob FROM p",
    "consensus_seq": f"WITH {PROFILE} SELECT pos, base FROM p QUALIFY row_number() OVER (PARTITION BY pos ORDER BY prob DESC, instr('ATCG', base)) = 1",
    "emission_smooth": f"WITH {SMOOTH} SELECT pos, base, round(prob, 9) AS prob FROM h",
    "degenerate_emission": f"""WITH {SMOOTH}, d(symbol, base, n) AS (VALUES {STANDS})
SELECT pos, symbol, round(ln(sum(prob) / any_value(n)), 8) AS logp FROM h JOIN d USING (base) GROUP BY pos, symbol""",
    "hmm_init": _hmm_init_sql(),
    "hyper_grid": f"""WITH {R}, w AS (SELECT seq_ord, seq, unnest(range(0, length(seq))) AS pos FROM s),
v AS (SELECT *, substr(seq, pos + 1, 1) AS c, (pos = 0)::int + 2 * (pos = length(seq) - 1)::int AS h FROM w),
n AS (SELECT pos, c, h, count(*) AS n FROM v GROUP BY ALL),
e AS (SELECT a.pos, a.c AS c1, a.h AS h1, b.c AS c2, b.h AS h2, count(*) AS w FROM v a JOIN v b ON a.seq_ord = b.seq_ord AND b.pos = a.pos + 1 GROUP BY ALL),
g(param_id, stem, pseudocount) AS (VALUES {', '.join(f'({i}::bigint, {share}::double, {add}::double)' for i, (share, add) in enumerate(consensus.GRID))}),
x AS (SELECT param_id, stem, pseudocount, count(*)::bigint AS n_edges, sum(w)::bigint AS weight FROM g, e JOIN n y ON y.pos = e.pos AND y.c = c1 AND y.h = h1
  JOIN n z ON z.pos = e.pos + 1 AND z.c = c2 AND z.h = h2 WHERE w > stem * y.n AND w > stem * z.n GROUP BY ALL),
f AS (SELECT b, avg((substr(seq, 1, 1) = b)::int) AS p FROM s, (SELECT unnest(['A', 'T', 'C', 'G']) AS b) WHERE seq <> '' GROUP BY b)
SELECT x.*, (SELECT round(max(p + exp(pseudocount)) / sum(p + exp(pseudocount)), 9) FROM f) AS top FROM x""",
    "column_layout": f"WITH {SLOTS} SELECT pos, n_insert, first_insert, first_insert + n_insert AS match_col FROM l",
    "cell_place": f"""WITH {SLOTS}, t AS (SELECT l_orderkey * 8 + l_linenumber AS row, l_partkey AS pos, CASE WHEN floor(l_quantity) % 2 = 0 THEN 0 ELSE 2 END AS state,
  substr('ATCGRXN', l_linenumber, 1) AS symbol FROM lineitem)
SELECT row::bigint AS row, CASE WHEN state = 0 THEN first_insert + n_insert ELSE first_insert + n_insert - 1 END::bigint AS col,
  CASE WHEN instr('{ALIGNED}', symbol) > 0 THEN instr('{ALIGNED}', symbol) - 1 ELSE 15 END::bigint AS sym
FROM t JOIN l USING (pos) WHERE state = 0 OR n_insert > 0""",
    "sparse_encode": f"""WITH {R}, {CELLS}, y AS (SELECT row, col, instr('{ALIGNED}', symbol) - 1 AS sym FROM c),
g AS (SELECT col, sym, count(*) AS n, string_agg(row::varchar, ',' ORDER BY row) AS r FROM y GROUP BY col, sym),
m AS (SELECT col, sym AS main FROM g QUALIFY row_number() OVER (PARTITION BY col ORDER BY n DESC, sym) = 1)
SELECT col, main::bigint AS main, coalesce(string_agg(sym || ':' || r, ';' ORDER BY sym) FILTER (sym <> main), '') AS minors FROM g JOIN m USING (col) GROUP BY col, main""",
    "sparse_round_trip": f"""WITH {R}, {CELLS}, o AS (SELECT seq_ord AS row, row_number() OVER (ORDER BY seq_ord) - 1 AS number FROM s)
SELECT col::bigint AS col, (instr('{ALIGNED}', symbol) - 1)::bigint AS sym, count(*)::bigint AS n, sum(number)::bigint AS rows FROM c JOIN o USING (row) GROUP BY ALL""",
    "merged_alignment": """WITH i AS (SELECT l_suppkey % 5 AS part, l_partkey AS pos, l_linenumber AS line, l_orderkey FROM lineitem),
p AS (SELECT part, pos, max(line) % 4 AS own FROM i GROUP BY ALL), w AS (SELECT pos, max(own) AS n FROM p GROUP BY pos),
l AS (SELECT pos, sum(n + 1) OVER (ORDER BY pos) - 1 AS match_col FROM w),
z AS (SELECT part, coalesce(sum(m) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_row FROM (SELECT part, max(l_orderkey) AS m FROM i GROUP BY part))
SELECT (match_col - line + 1)::bigint AS col, line::bigint AS sym, count(*)::bigint AS n, sum(l_orderkey + first_row)::bigint AS rows
FROM i JOIN p USING (part, pos) JOIN l USING (pos) JOIN z USING (part) WHERE line <= own + 1 GROUP BY ALL""",
    "fasta_render": f"WITH {R} SELECT seq_ord AS row, rpad(seq, (SELECT max(length(seq)) FROM s)::int, '-') AS aligned FROM s",
    "alignment_merge": """WITH p AS (SELECT l_suppkey % 5 AS part, l_partkey AS pos, (max(l_linenumber) % 4)::bigint AS own FROM lineitem GROUP BY ALL),
w AS (SELECT pos, max(own) AS n FROM p GROUP BY pos),
l AS (SELECT *, coalesce(sum(n + 1) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM w)
SELECT part, pos, own, (n - own)::bigint AS padding, (f + n - own)::bigint AS first_own, (f + n)::bigint AS match_col FROM p JOIN l USING (pos)""",
    "row_offsets": """WITH p AS (SELECT source AS part, count(*)::bigint AS n_rows FROM documents GROUP BY source)
SELECT part, n_rows, coalesce(sum(n_rows) OVER (ORDER BY part NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS first_row FROM p""",
    "report_rank": """WITH s AS (SELECT c_nationkey::bigint AS param_id, round(max(c_acctbal), 2) AS sp, round(min(c_acctbal), 2) AS entropy, count(*)::bigint AS length
  FROM customer GROUP BY c_nationkey)
SELECT *, row_number() OVER (ORDER BY sp DESC, param_id) = 1 AS best_sp, row_number() OVER (ORDER BY entropy, param_id) = 1 AS best_entropy FROM s""",
}
