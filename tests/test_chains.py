"""Chain graphs read off sequences: against SQL, with nothing dealt out by node, and alike however they are cut."""

import random
from pathlib import Path

import pytest

from seqloom.operators import chains
from seqloom.plans import catalogue
from seqloom.shipping import ship
from tests.test_tables import SMALLEST, exchanged, test_query_against_duckdb as against_duckdb

QUERIES = ["chain_edges", "chain_nodes", "degrees", "edge_prior", "edge_stem_filter", "equiv_merge_edges", "equiv_merge_nodes", "fragment_reduce", "fragment_index", "graph_union", "heavy_path_nodes", "lineage_compose", "parents_children", "occurrence_lookup", "same_fragment_pairs", "unique_anchor", "start_end_nodes"]
#: kernel, its columns, those that tell rows apart (summed over pieces), whether it needs edges
KERNELS = [
    (chains.edge_weights, "weight long, n long", ["weight"], True),
    (chains.node_weights, "headtail long, weight long, n long, coords long", ["headtail", "weight"], False),
    (chains.degree_counts, "n_in long, n_out long, n long", ["n_in", "n_out"], True),
    (chains.priors, "n_sure long, priors double", [], True),
    (chains.stems(0.1), "n long, weight long", [], True),
    (chains.merged_edges, "weight long, n long, src_ord long, src_pos long, dst_ord long, dst_pos long", ["weight"], True),
    (chains.merged_nodes, "headtail long, weight long, n long, ords long, places long", ["headtail", "weight"], False),
    (chains.reduced(2), "fragment string, headtail long, n long, weight long, coords long, offsets long, n_edges long", ["fragment", "headtail"], True),
    (chains.united, "sources long, weight long, n long, coords long", ["sources", "weight"], False),
    (chains.heavy(0), "fragment string, coord long, headtail long, weight long", ["fragment", "coord", "headtail"], False),
    (chains.node_counts, "nodes long, windows long, sites long", [], False),
    (chains.start_children_end_parents, "kind string, n long, weight long", ["kind"], True),
    (chains.starts_ends, "n_start long, w_start long, n_end long, w_end long", [], False),
]


@pytest.mark.parametrize("name", QUERIES)
def test_nodes_and_edges_are_not_dealt_out(spark, name):
    if not Path(SMALLEST).exists():
        pytest.skip("no tables here")
    ship(spark)
    found = exchanged(catalogue.queries()[name](spark, SMALLEST))
    assert "Exchange" in found and not any(c in found for c in ("node_id", "src#", "dst#", "src_node", "coord#", "pos#"))
    against_duckdb(spark, name)


@pytest.mark.parametrize("case", KERNELS, ids=str)
def test_pieces_of_any_size_say_the_same(spark, case):
    """Sequences with other symbols, too, and a fragment too long for one word."""
    kernel, schema, keys, edges = case
    rnd = random.Random(3)
    seeds = ["".join(rnd.choice(letters) for _ in range(90)) for letters in ("ATCG", "AT", "ATCGN", "éATCG")]
    seqs = [s[rnd.randrange(3) : rnd.randrange(30, 91)] for s in seeds for _ in range(6)] + ["ATCGA", "AT", ""]
    df = spark.createDataFrame([(i % 4 + 1, i % 3, i, s) for i, s in enumerate(seqs)], "graph_id long, source long, seq_ord long, seq string")
    for k in (4, 40):
        one, many = (
            sorted((tuple(r) for r in chains.summed(chains.over_chains(df, k, kernel, schema, "source", edges=edges, step=step), *keys).collect()), key=str)
            for step in (1 << 15, 7)
        )
        assert [[round(x, 9) if isinstance(x, float) else x for x in r] for r in one] == [[round(x, 9) if isinstance(x, float) else x for x in r] for r in many] and one
