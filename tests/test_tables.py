"""Hand-worked cases for the relational operators, and whole queries against DuckDB on the smallest tables."""

import math
import random
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import symbols
from seqloom.operators import alignment, build, graph, islands, kernels, profile
from seqloom.__main__ import main
from seqloom.plans import align, catalogue, run
from seqloom.plans.storage import load_alignment, load_graphs, shared_path, written
from seqloom.shipping import ship
from seqloom.sources.fasta import read_fasta, write_fasta
from tests.test_kernels import mutated

SMALLEST = "/root/testdata/sf0.001"
CHECKED = [
    "seq_lengths", "avg_length_chunk_size", "chunk_assign", "kmer_diversity", "jaccard_pairs", "unambiguous_filter", "pack_unpack", "null_runs", "interval_union",
    "chain_nodes", "degrees", "fragment_reduce", "coords_bwd", "reachability", "sp_score", "majority_rebase", "hmm_init", "column_layout", "cell_place",
    "sparse_encode", "fasta_render", "alignment_merge", "report_rank", "islands_components", "unitigs", "heaviest_path", "longest_path_nodes", "state_range",
    "hmm_exact", "hmm_exact_counts", "viterbi_exact", "fasta_records", "mean_jaccard", "sparse_round_trip", "merged_alignment", "graph_paths",
]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def anchors(spark):
    values = [5, 6, None, 8, 9, 3]
    return spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], "seq_ord long, idx int, val int")


def test_islands(spark, anchors):
    assert rows(islands.strict_islands(anchors)) == [(0, 3, 5, 3, 5, 0, -2), (0, 5, 0, 6, 1, 1, 5), (0, 8, 3, 9, 4, 1, 5)]
    assert rows(islands.diagonal_islands(anchors)) == [(0, 3, 5, 3, 5, 1, -2), (0, 5, 0, 9, 4, 4, 5)]
    blocks = spark.createDataFrame([(0, 3, 4)], "seq_ord long, i0 int, i1 int")
    assert [r["val"] for r in islands.remove_blocks(anchors, blocks).orderBy("idx").collect()] == [5, 6, None, None, None, 3]


def test_null_runs(spark):
    values = [None, 4, None, None, 9, None]
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], "seq_ord long, idx int, val int")
    assert islands.null_runs(df).orderBy("first").collect() == [(0, 0, 0, 0, 4), (0, 2, 3, 4, 9), (0, 5, 5, 9, None)]


def test_interval_union_merges_touching_ones(spark):
    df = spark.createDataFrame([(1, 1, 1, 3), (1, 2, 3, 5), (1, 3, 7, 8)], "grp long, payload long, lo long, hi long")
    assert rows(islands.interval_union(df)) == [(1, 1, 5, 2, 3), (1, 7, 8, 1, 3)]


def test_chunk_size(spark):
    df = spark.createDataFrame([(1000.0,), (25000.0,), (30000.0,), (100000.0,), (0.0,)], "a double")
    assert [r[0] for r in df.select(profile.chunk_size(F.col("a"))).collect()] == [10000, 9016, 4984, 100, 10000]


def test_windows_of_long_and_short_sequences(spark):
    seq = "".join(random.Random(0).choice("ATCG") for _ in range(1500))
    df = spark.createDataFrame([(1, seq), (2, "AT"), (3, "ATC")], "seq_ord long, seq string")
    found = {(r["seq_ord"], r["pos"]): r["fragment"] for r in profile.windows(df, 3).collect()}
    assert found == {(1, i): seq[i : i + 3] for i in range(1498)} | {(3, 0): "ATC"}
    empty = profile.kmer_diversity(df.where("seq_ord = 2"), 3).first()
    assert (empty["total"], empty["ratio"]) == (0, 0.0)


def test_scores_of_small_columns(spark):
    cells = [(0, 0, 1), (1, 0, 1), (2, 0, 2)]
    counts = alignment.symbol_counts(spark.createDataFrame(cells, "row long, col int, sym int"), 4)
    scores = alignment.column_scores(alignment.base_counts(counts))
    r = alignment.alignment_score(scores).first()
    assert (r["pos"], r["neg"]) == (1, -8) and r["sp"] == pytest.approx(-7 / 6) and r["entropy"] == pytest.approx(1.0397207708)
    counts = spark.createDataFrame([(0, 1, 1), (0, 5, 1)], "col int, sym int, n long")
    r = alignment.alignment_score(alignment.column_scores(alignment.base_counts(counts))).first()
    assert (r["pos"], r["neg"], r["sp"]) == (0.25, -0.75, -0.5)
    empty = alignment.alignment_score(alignment.column_scores(alignment.base_counts(counts.where("col = 9")))).first()
    assert (empty["n_cols"], empty["sp"]) == (0, 0)


def test_packing_and_symbols(spark):
    df = spark.createDataFrame([(3, 7), (-1, 0), (1 << 40, 0)], "a long, b long")
    packed = df.select(symbols.pack(F.col("a"), F.col("b")).alias("p"))
    assert [r[0] for r in packed.collect()] == [(3 << 32) + 7, None, None]
    df = spark.createDataFrame([("aTcG",), ("ATN",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(symbols.unambiguous(F.col("s"))).collect()] == [True, False, True, False]


def test_merges_keep_weights(spark):
    seqs = spark.createDataFrame([(i, s, 1 + i // 2) for i, s in enumerate(["ATCGATC", "ATCGATG", "ATCGTTC", "ATCG"])], "seq_ord long, seq string, graph_id int")
    nodes, edges = graph.chain_nodes(seqs, 3), graph.chain_edges(seqs, 3)
    windows, steps = nodes.agg(F.sum("weight")).first()[0], edges.agg(F.sum("weight")).first()[0]
    assert (windows, steps) == (17, 13)
    assert graph.union_graphs(nodes).agg(F.sum("weight")).first()[0] == windows
    reduced, links = graph.reduce_fragments(nodes, edges, 3, 1)
    assert reduced.where("offset > 0").count() == 2 * nodes.where("headtail in (1, 3)").count()
    assert links.count() == edges.count() + reduced.where("offset > 0").count()
    kept, left = graph.compacted(nodes.withColumn("weight", F.when(F.col("coord") == 1, 0).otherwise(F.col("weight"))), edges)
    assert kept.where("coord = 1").count() == 0 and left.join(nodes.where("coord = 1"), left["src"] == nodes["node_id"]).count() == 0


def test_fasta_round_trip(spark):
    path = shared_path(spark, "fasta")
    df = spark.createDataFrame([("a x", "atcgu"), ("b", "GG")], "seq_id string, seq string")
    write_fasta(df, path)
    assert rows(read_fasta(spark, path, clean=True)) == [("a x", "a", "ATCGT"), ("b", "b", "GG")]


def test_alignment_of_mutated_copies(spark):
    ship(spark)
    rnd = random.Random(7)
    seed = "".join(rnd.choice("ATCG") for _ in range(70))
    seqs = [(i, mutated(seed, rnd)) for i in range(9)]
    result = align.aligned(spark.createDataFrame(seqs, "seq_ord long, seq string"), 8, 5, written)
    report, rows_of = result.report, [tuple(r) for r in result.rows(reference=True).collect()]
    assert [i for i, _ in rows_of] == [None, *range(9)] and set(rows_of[0][1]) <= set("ATCG-")
    found = dict(rows_of[1:])
    assert {i: r.replace("-", "") for i, r in found.items()} == dict(seqs)
    assert len({len(r) for r in found.values()}) == 1
    assert not any(all(r[c] == "-" for r in found.values()) for c in range(len(found[0])))
    assert report.where("best_entropy").count() == report.where("best_sp").count() == 1


@pytest.fixture(scope="module")
def small_graph(spark):
    """A graph of a few sequences as a kernel holds it before its nodes are merged, and as tables."""
    rnd = random.Random(14)
    seed = "".join(rnd.choice("ATCG") for _ in range(20))
    g = build.Builder(4)
    for _ in range(3):
        path = []
        s = mutated(seed, rnd, 0.05)
        for i in range(len(s) - 3):
            path.append(g.node(s[i : i + 4], (1 if i == 0 else 0) | (2 if i == len(s) - 4 else 0), i + 1))
            g.weight[path[-1]] = 1
        for a, b in zip(path, path[1:], strict=False):
            g.edges[a, b] += 1
        g.paths.append(path)
    nodes = [(1, v, f, w, h, c) for v, (f, w, h, c) in enumerate(zip(g.fragment, g.weight, g.headtail, g.level, strict=True))]
    edges = [(1, a, b, w) for (a, b), w in g.edges.items()]
    return (
        g, spark.createDataFrame(nodes, "graph_id int, node_id long, fragment string, weight long, headtail int, coord int"),
        spark.createDataFrame(edges, "graph_id int, src long, dst long, weight long"),
    )


def test_levels_and_merges_in_rounds(spark, small_graph):
    g, nodes, edges = small_graph
    assert dict((r["node_id"], r["level"]) for r in graph.layered(nodes, edges, written, False).collect()) == dict(enumerate(kernels.layers(g.dag(), False).tolist()))
    merged, links, mapping = graph.merge_to_fixpoint(nodes, edges, written)
    one = build.Builder(4)
    for f, h, c in zip(g.fragment, g.headtail, g.level, strict=True):
        one.node(f, h, c)
    one.weight, one.edges, one.paths = list(g.weight), dict(g.edges), [list(range(len(g.fragment)))]
    one.merge_equal()
    expected = sorted(zip(one.fragment, one.headtail, one.level, one.weight, strict=True))
    assert sorted((r["fragment"], r["headtail"], r["coord"], r["weight"]) for r in merged.collect()) == expected
    groups = {}
    for r in mapping.collect():
        groups.setdefault(r["node_id"], set()).add(r["old"])
    assert sorted(map(sorted, groups.values())) == sorted(sorted(v for v in range(len(g.fragment)) if one.paths[0][v] == n) for n in range(len(one.fragment)))
    assert links.agg(F.sum("weight")).first()[0] == sum(g.edges.values())


def test_ids_are_compacted_and_nodes_removed(spark, small_graph):
    g, nodes, edges = small_graph
    spread = F.xxhash64("node_id")
    far = nodes.withColumn("weight", F.when(F.col("coord") == 3, 0).otherwise(F.col("weight"))).withColumn("node_id", spread)
    kept, links, mapping = graph.compact_ids(far, edges.withColumn("src", F.xxhash64("src")).withColumn("dst", F.xxhash64("dst")))
    n = sum(c != 3 for c in g.level)
    assert sorted(r["node_id"] for r in kept.collect()) == list(range(n)) and mapping.count() == n
    assert links.count() == sum(3 not in (g.level[a], g.level[b]) for a, b in g.edges)
    order = [r["node_id"] for r in mapping.orderBy("old").collect()]
    assert order == sorted(order)
    assert graph.removed(nodes, nodes.where("coord = 3")).count() == n


def test_tagged_walks(spark, small_graph):
    g, nodes, edges = small_graph
    starts = [p[0] for p in g.paths]
    sources = spark.createDataFrame([(1, v, v) for v in starts], "graph_id int, node_id long, tag long")
    banned = g.paths[0][5]
    found = graph.reached(nodes, edges, sources, written, banned=nodes.where(F.col("node_id") == banned), step=F.abs(F.col("next_coord") - F.col("coord")) == 1)
    clean = np.arange(len(g.fragment)) != banned
    expected = {(v, s) for s in starts for v in np.flatnonzero(kernels.reachable(g.dag(), [s], True, clean)).tolist()}
    assert {(r["node_id"], r["tag"]) for r in found.collect()} == expected
    assert graph.reached(nodes, edges, sources, written, step=F.col("next_coord") <= 3).agg(F.max("node_id")).first()[0] is not None


def test_log_sum_exp_far_below_zero(spark):
    df = spark.createDataFrame([(1, None, -800.0), (1, None, -800.0), (2, "x", float("-inf")), (3, "", 700.0), (3, "", -800.0)], "a int, b string, logp double")
    found = {r["a"]: r["logp"] for r in symbols.log_sum_exp(df, ["a", "b"], "logp").collect()}
    assert found[1] == pytest.approx(-800 + math.log(2)) and found[2] == float("-inf") and found[3] == pytest.approx(700)


def test_training_on_rare_states(spark):
    ship(spark)
    rows = [(p, "freq", j, b, math.log(0.25)) for p in (0, 1) for j in range(3) for b in "ATCG"] + [(p, "occ_m", j, "", -800.0) for p in (0, 1) for j in range(3)]
    rows += [(p, "start", i, "", -1.0) for p in (0, 1) for i in range(3)] + [(0, "hot", 1, "2", 0.0)]
    models = align.models_of(align.trained(spark.createDataFrame(rows, align.COUNTS)))
    assert sorted(models) == [0, 1] and all(len(r) == 3 and not any(np.isnan(x).any() for x in p.values()) for r, p in models.values())


def test_sparse_columns_keep_gaps(spark):
    rnd = random.Random(11)
    dense = [[rnd.choice([0, 0, 1, 2, 3]) for _ in range(9)] for _ in range(23)]
    dense[5] = [0] * 9
    cells = spark.createDataFrame([(i, c, s) for i, r in enumerate(dense) for c, s in enumerate(r) if s], "row long, col int, sym int")
    counts = alignment.symbol_counts(cells, 23)
    columns = alignment.sparse_columns(cells, alignment.majority_mains(counts), 23, step=4).cache()
    assert rows(alignment.cells_of(columns, 23, step=4)) == rows(cells) and rows(alignment.counts_of(columns, 23)) == rows(counts)
    assert max(len(r["rows"]) for r in columns.collect() if r["rows"]) <= 4
    other = alignment.sparse_columns(cells, counts.groupBy("col").agg(F.min("sym").alias("main")), 23, step=4)
    assert rows(alignment.rebased(other, 23, step=4).groupBy("col", "main").count().select("col", "main")) == rows(alignment.majority_mains(counts))


def test_samples_of_similarity(spark):
    seqs = spark.createDataFrame([(i, s) for i, s in enumerate(["ATCGAT", "ATCGAA", "GGGGGG", "A", "", "C"])], "seq_ord long, seq string")
    sets = [{s[i : i + 3] for i in range(len(s) - 2)} for s in ("ATCGAT", "ATCGAA", "GGGGGG", "A", "", "C")]
    values = [1.0 if not x | y else len(x & y) / len(x | y) for n, x in enumerate(sets) for y in sets[:n]]
    assert profile.mean_jaccard(seqs, 3).first()[0] == pytest.approx(sum(values) / len(values))
    assert 0 <= profile.mean_jaccard_of_samples(seqs, 3, 4, 2).first()[0] <= 1 and profile.mean_jaccard(seqs, 3, sample=1).first()[0] == 1
    assert profile.kmer_diversity(seqs, 3, sample=2).first()["total"] <= 8


def test_a_file_is_aligned_into_a_folder(spark, tmp_path):
    ship(spark)
    rnd = random.Random(12)
    seed = "".join(rnd.choice("ATCG") for _ in range(60))
    seqs = {f"s{i}": mutated(seed, rnd) for i in range(7)}
    (tmp_path / "in.fasta").write_text("".join(f">{n} x\n{s}\n" for n, s in seqs.items()))
    target = f"file://{tmp_path}/out"
    main(["-i", f"file://{tmp_path}/in.fasta", "-o", target, "-f", "8", "-c", "3"])
    drawn = {r["seq_id"]: r["seq"] for r in read_fasta(spark, f"{target}/align_result.fasta").collect()}
    assert {n: s.replace("-", "") for n, s in drawn.items()} == seqs and len({len(s) for s in drawn.values()}) == 1
    columns, names = load_alignment(spark, f"{target}/alignment")
    letters = {n: {} for n in seqs}
    of = {r["number"]: r["seq_id"] for r in names.collect()}
    for r in alignment.cells_of(columns, 7).collect():
        letters[of[r["row"]]][r["col"]] = symbols.ALIGNED[r["sym"]]
    assert all("".join(letters[n].get(c, "-") for c in range(len(s))) == s for n, s in drawn.items())
    report = (tmp_path / "out" / "report.txt").glob("part-*")
    assert "entropy" in next(report).read_text().splitlines()[0]
    frequency = spark.read.parquet(f"{target}/consensus").where("kind = 'freq'").groupBy("param_id", "pos").agg(F.sum(F.exp("logp")).alias("p")).collect()
    assert len(frequency) > 100 and all(r["p"] == pytest.approx(1) for r in frequency)
    best = spark.read.parquet(f"{target}/parameters").select("param_id").distinct().count()
    assert best == 2 and run.stored_scores(spark, target).first()["n_cols"] == len(next(iter(drawn.values())))
    assert load_graphs(spark, f"{target}/graphs", 0, ("node",), [2]).select("graph_id").distinct().collect() == [(2,)]
    main(["-i", f"file://{tmp_path}/in.fasta", "-o", f"{target}2", "-c", "3", "-b"])
    assert load_graphs(spark, f"{target}2/graphs", 2).count() > 0 and not (tmp_path / "out2" / "alignment").exists()
    assert run.sizes(spark.createDataFrame([(1, "ATCG" * 30)], "seq_ord long, seq string")) == (32, 10000)
    assert run.sizes(None, large=True) == (32, 5000) and align.decoding_level(5000, 9) == 4 and align.decoding_level(100, 3) == 2


@pytest.mark.parametrize("name", CHECKED)
def test_query_against_duckdb(spark, name):
    if not Path(SMALLEST).exists():
        pytest.skip("no tables here")
    ship(spark)
    base = duckdb.connect()
    for p in Path(SMALLEST).glob("*.parquet"):
        base.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got, expected = catalogue.queries()[name](spark, SMALLEST), base.sql(catalogue.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    key = lambda r: tuple(str(x) for x in r)
    ours = sorted((tuple(r) for r in got.select(*columns).collect()), key=key)
    theirs = sorted(expected.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall(), key=key)
    assert ours == theirs


def test_kmers_are_counted_in_packed_pieces(spark):
    """Runs, repeated texts, k-mers with other symbols, and sequences shorter than k; nothing but pieces travels."""
    rnd = random.Random(5)
    seed = "".join(rnd.choice("ATCG") for _ in range(40_000))
    texts = [seed, seed, seed[7:900], "A" * 700, "T" * 32, "ATC", "", "ACGNNACGT" * 30, "é" + seed[:50], *[seed[i : i + 60] for i in range(0, 3000, 40)] * 12]
    df = spark.createDataFrame(list(enumerate(texts)), "seq_ord long, seq string").repartition(3)
    for k in (3, 31, 32, 33):
        counts = {}
        for t in texts:
            for i in range(len(t) - k + 1):
                counts[t[i : i + k]] = counts.get(t[i : i + k], 0) + 1
        expected = {}
        for f, n in counts.items():
            expected.setdefault(n, []).append(f)
        assert rows(profile.kmer_tallies(df, k).select("n", "n_kmers", "first_kmer")) == sorted((n, len(f), min(f)) for n, f in expected.items())
        found = profile.kmer_diversity(df, k).first()
        assert (found["total"], found["distinct_kmers"]) == (sum(counts.values()), len(counts))


def exchanged(df) -> str:
    """What the exchanges of a plan deal by."""
    return "\n".join(x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x)


@pytest.mark.parametrize("name", ["kmer_counts", "kmer_diversity", "fragment_length_choice"])
def test_windows_are_not_dealt_out(spark, name):
    ship(spark)
    found = exchanged(catalogue.queries()[name](spark, SMALLEST))
    assert "Exchange" in found and "fragment" not in found


def shuffled(spark) -> int:
    """Bytes that this session's tasks have written for exchanges so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


def test_fragment_length_is_chosen_on_few_bytes_a_symbol(spark, tmp_path):
    """Exactly 0.9 of the k-mers distinct is diverse, one copy more isn't; exchanges take less than 4 bytes for each k-mer."""
    rnd, n = random.Random(11), 50_000
    texts = ["".join(rnd.choices("abcdEFGH", k=n + 31)) for _ in range(9)]
    texts += [texts[0].swapcase(), None, "", "a-b c"]
    for more, expected in (([], 16), ([texts[3][:32]], 32)):
        path = f"{tmp_path}/{expected}"
        spark.createDataFrame(list(enumerate(texts + more)), "doc_id long, text string").repartition(3).write.parquet(f"{path}/documents.parquet")
        before = shuffled(spark)
        assert rows(catalogue.queries()["fragment_length_choice"](spark, path)) == [(expected,)]
        sent = shuffled(spark) - before
        documents = duckdb.read_parquet(f"{path}/documents.parquet/*.parquet")  # noqa: F841
        assert duckdb.sql(catalogue.oracle_sql()["fragment_length_choice"]).fetchall() == [(expected,)]
        assert 0 < sent < 4 * 10 * n


def test_kmer_sets_are_sized_by_sequence(spark):
    rnd = random.Random(8)
    texts = ["".join(rnd.choice(a) for _ in range(n)) for a in ("ATCG", "AT", "ATCGNRY", "éA") for n in (0, 2, 5, 40, 3000)]
    df = spark.createDataFrame([(i // 2, s) for i, s in enumerate(texts)], "seq_ord long, seq string").repartition(3)  # two rows have one seq_ord
    for k in (3, 21, 40):
        sets = {}
        for i, s in enumerate(texts):
            sets.setdefault(i // 2, set()).update(s[j : j + k] for j in range(len(s) - k + 1))
        found = profile.kmer_set_sizes(df, k)
        assert rows(found) == sorted((i, len(x)) for i, x in sets.items() if x) and "fragment" not in exchanged(found)


ISLAND_QUERIES = ["islands_strict", "islands_diagonal", "null_runs"]


@pytest.mark.parametrize("name", ISLAND_QUERIES)
def test_anchors_are_read_off_sequences(spark, name):
    """As the tables of anchors have it, other symbols, short and repeated sequences included; no window is dealt out."""
    ship(spark)
    rnd = random.Random(9)
    base = "".join(rnd.choice("ATCG") for _ in range(400))
    texts = [base, base[50:200] + "TT" + base[210:300], base[100:] + base[:90], "ATNé" * 9, "", "AT", *[mutated(base[i : i + 150], rnd) for i in range(0, 250, 30)]]
    df = spark.createDataFrame(list(enumerate(texts)), "seq_ord long, seq string")
    table, texts_of = {
        "islands_strict": (islands.strict_islands, islands.strict_islands_of_windows),
        "islands_diagonal": (islands.diagonal_islands, islands.diagonal_islands_of_windows),
        "null_runs": (islands.null_runs, islands.null_runs_of_windows),
    }[name]
    for k in (3, 8, 14):
        places = {}
        for i in range(len(base) - k + 1):
            places.setdefault(base[i : i + k], []).append(i)
        anchors = [(s, i, p[0] if len(p := places.get(t[i : i + k], [])) == 1 else None) for s, t in enumerate(texts) for i in range(len(t) - k + 1)]
        expected = table(spark.createDataFrame(anchors, "seq_ord long, idx long, val long"))
        found = texts_of(df, base, k).select(*expected.columns)
        assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, expected.collect()), key=str)
    plan = exchanged(catalogue.queries()[name](spark, SMALLEST))
    assert "fragment" not in plan and "idx" not in plan
