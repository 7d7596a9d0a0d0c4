"""Hand-worked cases and brute force for the ordered kernels."""

import itertools
import random

import numpy as np
import pytest

from seqloom.operators import build, consensus, hmm, kernels
from seqloom.plans import align
from seqloom.sources.fasta import checked_path, report_text


def mutated(seed, rnd, rate=0.02):
    out = []
    for c in seed:
        r = rnd.random()
        if r < rate:
            out.append(rnd.choice("ATCG"))
        elif r < 1.5 * rate:
            continue
        elif r < 2 * rate:
            out += [c, rnd.choice("ATCG")]
        else:
            out.append(c)
    return "".join(out)


def test_layers_and_state_ranges():
    g = kernels.Dag(3, [0, 1, 0], [1, 2, 2])
    assert kernels.layers(g).tolist() == [1, 2, 3] and kernels.layers(g, False).tolist() == [3, 2, 1]
    g = kernels.Dag(4, [0, 1, 0, 3], [1, 2, 3, 2])
    lo, hi = kernels.state_ranges(g, [0, 1, 2], 3)
    assert (lo[3], hi[3]) == (0, 2)
    assert kernels.state_ranges(g, [0, 1, 2], 3, extend=True)[1][0] == 2
    with pytest.raises(ValueError):
        kernels.Dag(2, [0, 1], [1, 0])


def test_heaviest_chain_against_brute_force():
    assert kernels.heaviest_chain([(1, 5, 5), (3, 4, 2), (6, 8, 3)]) == [1]
    rnd = random.Random(1)
    for _ in range(50):
        blocks = [(a := rnd.randrange(20), a + rnd.randrange(4), rnd.randrange(1, 9)) for _ in range(rnd.randrange(1, 8))]
        kept = [b for i, b in enumerate(blocks) if i not in kernels.heaviest_chain(blocks)]
        rising = lambda bs: all(x[1] < y[0] for x, y in zip(bs, bs[1:], strict=False))
        best = max(sum(b[2] for b in c) for n in range(len(blocks) + 1) for c in itertools.combinations(blocks, n) if rising(c))
        assert rising(kept) and sum(b[2] for b in kept) == best


def test_rising_choice():
    slots = [[(0, 3, 6), (1, 7, 7)], [(2, 5, 4)]]
    assert kernels.rising_choice(slots) == [1, -1]
    assert kernels.rising_choice(slots, optimal=True) == [0, 2]
    assert kernels.rising_choice([[], []]) == [-1, -1]


def test_heaviest_path_against_enumeration():
    rnd = random.Random(2)
    for _ in range(30):
        n = rnd.randrange(1, 7)
        edges = [(a, b, rnd.randrange(1, 9)) for a in range(n) for b in range(a + 1, n) if rnd.random() < 0.5]
        g = kernels.Dag(n, *([e[i] for e in edges] for i in range(3)))
        w = {(a, b): x for a, b, x in edges}
        paths = [[v] for v in range(n)]
        for p in paths:
            paths += [[*p, b] for a, b, _ in edges if a == p[-1]]
        total = lambda p: sum(w[e] for e in zip(p, p[1:], strict=False))
        sinks = [v for v in range(n) if not len(g.children(v))]
        assert total(kernels.heaviest_path(g)) == max(total(p) for p in paths if p[-1] in sinks)


def test_unitigs_and_islands():
    g = kernels.Dag(5, [0, 1, 1, 2, 3], [1, 2, 3, 4, 4])
    of, paths, links = kernels.unitigs(g)
    assert paths == [[0, 1], [2], [3], [4]] and len(links) == 4 and of[1] == 0
    assert kernels.islands(5, [0, 3], [1, 4]).tolist() == [0, 0, 2, 3, 3]
    assert kernels.stays_acyclic(g, [2, 3]) and not kernels.stays_acyclic(g, [0, 4])
    clean = np.array([True, True, False, True, True])
    assert kernels.without_degenerate(g, clean, [0], [4]).tolist() == [True, True, False, True, True]


def test_builder_keeps_sequences_and_levels():
    rnd = random.Random(3)
    seed = "".join(rnd.choice("ATCG") for _ in range(150))
    seqs = [mutated(seed, rnd) for _ in range(12)]
    g = build.built(seqs, 12)
    assert [g.fragment[p[0]] + "".join(g.fragment[v][-1] for v in p[1:]) for p in g.paths] == seqs
    assert all(g.level[a] < g.level[b] for a, b in g.edges)
    starts = sum(w for w, h in zip(g.weight, g.headtail, strict=True) if h & 1)
    assert starts == sum(w for w, h in zip(g.weight, g.headtail, strict=True) if h & 2) == len(seqs)
    merged, a, b = build.merged_graphs(build.built(seqs[:6], 12), build.built(seqs[6:], 12))
    assert sum(merged.weight) == sum(g.weight)
    assert sorted(merged.fragment[p[0]] + "".join(merged.fragment[v][-1] for v in p[1:]) for p in merged.paths) == sorted(seqs)
    with pytest.raises(ValueError):
        build.Builder(12).add("ATC")
    one = build.built(["ATCGATCGATCG"], 12)
    assert one.headtail == [3]


def brute_force(p, length, x):
    """ln P and the best ln probability over all state paths."""
    found = []

    def go(state, j, i, total):
        if i == len(x) and state != "S":
            end = {"M": p["mm"][length] if j == length - 1 else -np.inf, "D": p["dm"][length] if j == length - 1 else -np.inf, "I": p["im"][length] if j == length else -np.inf}
            found.append(total + end[state])
        to = 0 if state == "S" else j if state == "I" else j + 1
        names = {"S": ("mm", "mi", "md"), "M": ("mm", "mi", "md"), "I": ("im", "ii", "id"), "D": ("dm", "di", "dd")}[state]
        for target, name in zip("MID", names, strict=True):
            if to > length or target != "I" and to >= length or not np.isfinite(p[name][to]):
                continue
            if target == "D":
                go("D", to, i, total + p[name][to])
            elif i < len(x):
                emit = p["match"][to] if target == "M" else p["insert"][to]
                go(target, to, i + 1, total + p[name][to] + emit["ATCG".index(x[i])])

    go("S", -1, 0, 0.0)
    return np.logaddexp.reduce(found), max(found)


def test_passes_against_all_state_paths():
    rnd = random.Random(4)
    for t in range(8):
        length, x = rnd.choice([1, 2, 3]), "".join(rnd.choice("ATCG") for _ in range(rnd.choice([1, 2, 3])))
        p = consensus.start_parameters(np.random.default_rng(t).dirichlet(np.ones(4), length), [(1, 2)])
        g = build.Builder(1)
        g.add(x)
        model = hmm.Model(g, consensus.Consensus([None] * length, np.full((length, 4), 0.25), []), p)
        total, best = brute_force(p, length, x)
        assert model.forward()[1] == pytest.approx(total) and model.backward()[1] == pytest.approx(total)
        found = model.viterbi()
        end = g.paths[0][-1]
        assert model.finish(*model.full(end, found[end]), np.maximum) == pytest.approx(best)
        counts = model.expectations()
        assert sum(np.exp(v) for k, _, _, v in counts if k in ("emit", "occ_i")) == pytest.approx(len(x))
        assert sum(np.exp(v) for k, _, _, v in counts if k == "start") == pytest.approx(1)


def test_training_raises_the_likelihood():
    rnd = random.Random(5)
    seed = "".join(rnd.choice("ATCG") for _ in range(80))
    g, _ = consensus.symbol_graph(build.built([mutated(seed, rnd) for _ in range(10)], 8))
    ref = consensus.consensus(g)
    p = consensus.start_parameters(consensus.smoothed_emission(ref.frequency, -3), ref.inserts)
    model = hmm.Model(g, ref, p)
    forward, backward = model.forward()[1], model.backward()[1]
    assert forward == pytest.approx(backward)
    counts = {(k, j, s): v for k, j, s, v in model.expectations()}
    assert hmm.Model(g, ref, hmm.re_estimated(p, counts, -3)).forward()[1] > forward


def test_reference_maps_back_on_its_graph():
    rnd = random.Random(6)
    seed = "".join(rnd.choice("ATCG") for _ in range(60))
    g = build.built([seed], 8)
    symbols, at = consensus.symbol_graph(g)
    nodes = align.mapped_reference(g, at, seed)
    assert nodes[:7] == [None] * 7 and all(symbols.fragment[v] == c for v, c in zip(nodes, seed, strict=True) if v is not None)
    back = align.graph_of(align.graph_rows(g, 3))
    assert (back.fragment, back.weight, back.headtail, back.level, back.edges) == (g.fragment, g.weight, g.headtail, g.level, g.edges) and back.backbone == g.backbone


def test_longest_rise():
    assert kernels.longest_rise([3, None, 1, 2, 5, 4, None, 6]) == [None, None, 1, 2, None, 4, None, 6] and kernels.longest_rise([None]) == [None]


def test_training_leaves_out_degenerate_symbols():
    g, _ = consensus.symbol_graph(build.built(["ATCGATCG", "ATCNATCG", "ATCGATCG"], 4))
    ref = consensus.consensus(g)
    p = consensus.start_parameters(consensus.smoothed_emission(ref.frequency, -3), ref.inserts)
    found = {s for k, _, s, _ in hmm.Model(g, ref, p, clean_only=True).expectations() if k == "emit"}
    assert found == set("ATCG") and "N" in {s for k, _, s, _ in hmm.Model(g, ref, p).expectations() if k == "emit"}
    only, _ = consensus.symbol_graph(build.built(["ATNGATCG"], 4))  # no clean path: the whole graph stays
    assert "N" in {s for k, _, s, _ in hmm.Model(only, consensus.Consensus([None] * 3, np.full((3, 4), 0.25), []), consensus.start_parameters(np.full((3, 4), 0.25)), clean_only=True).expectations() if k == "emit"}


def test_merged_paths_spell_their_sequences():
    rnd = random.Random(9)
    seed = "".join(rnd.choice("ATCG") for _ in range(120))
    seqs = [mutated(seed, rnd) for _ in range(8)]
    a, b = build.built(seqs[:4], 12), build.built(seqs[4:], 12)
    g, on_a, on_b = build.merged_graphs(a, b)
    for part, to in ((a, on_a), (b, on_b)):
        for p in part.paths:
            assert all((to[x], to[y]) in g.edges for x, y in zip(p, p[1:], strict=False)) and [g.fragment[to[v]] for v in p] == [part.fragment[v] for v in p]


def test_paths_and_reports():
    with pytest.raises(ValueError):
        checked_path("/a/../b")
    with pytest.raises(ValueError):
        checked_path("~/x")
    assert checked_path("file:///tmp/x") == "file:///tmp/x"
    assert report_text([{"id": 1, "sp": 0.5}]) == "id  sp\n1   0.50000"
