from __future__ import annotations

import random
from fractions import Fraction
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corelith import queries
from corelith.functions import binomial
from corelith.operators import approx, balance, cliques, closed_cores, components, cores, graph, patterns, peel, prune
from corelith.operators.exact import densest_set, solve_components
from corelith.operators.priced import densest_by_price, longest_densest
from corelith.plans import densest, session
from corelith.plans.densest import densest_subgraph, find_instances
from corelith.plans.session import cut
from tests import reference_graphs as R

EDGES = "src bigint, dst bigint"
GOLDEN = {
    ("G1", 2): (24, Fraction(12, 7), list(range(14))),
    ("G1", 3): (6, Fraction(1), [10, 11, 12, 13]),
    ("G1", 4): (1, Fraction(1, 4), [10, 11, 12, 13]),
    ("G2", 2): (14, Fraction(3, 2), [4, 5, 6, 7, 8, 9]),
    ("G2", 3): (4, Fraction(1), [6, 7, 8, 9]),
    ("G3", 2): (16, Fraction(5, 3), [0, 1, 2, 3, 4, 5]),
    ("G3", 3): (8, Fraction(1), [0, 1, 2, 3, 4, 5]),
    ("G3", 4): (1, Fraction(1, 4), [0, 1, 2, 3]),
}


def frame(spark, edges):
    return graph.canonical_edges(spark.createDataFrame(edges, EDGES))


def pairs(df):
    return {tuple(r) for r in df.collect()}


def random_edges(seed: int, n: int, p: float) -> list[tuple[int, int]]:
    rng = random.Random(seed)
    return [(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < p] or [(0, 1)]


@pytest.mark.parametrize("name, k", GOLDEN)
def test_golden_densest(spark, name, k):
    edges = frame(spark, R.edges_of(getattr(R, name)))
    count, density, members = GOLDEN[name, k]
    assert cliques.count_cliques(edges, k).first()[0] == count
    best = densest_subgraph(edges, k)
    assert Fraction(best.numer, best.denom) == density
    assert sorted(r[0] for r in best.members.collect()) == members
    assert best.exact


def test_solver_against_brute_force():
    rng = random.Random(5)
    for seed in range(60):
        edges = random_edges(seed, rng.randint(3, 8), rng.choice([0.3, 0.5, 0.8]))
        for k in (2, 3):
            found = {c: 1 for c in R.cliques(edges, k)}
            density, members = R.densest(found, R.ids_of(edges))
            assert densest_set([list(g) for g in found], list(found.values())) == (members, density, True)


def test_solver_with_multiplicities_and_a_floor():
    assert densest_set([[1, 2], [2, 3], [4, 5]], [3, 1, 4]) == ([4, 5], Fraction(2), True)
    assert densest_set([[1, 2], [2, 3], [4, 5]], [3, 1, 4], most_cuts=0) == ([1, 2, 3, 4, 5], Fraction(8, 5), False)
    assert densest_set([[1, 2]], [1], Fraction(2)) == ([], Fraction(0), True)
    assert densest_set([], []) == ([], Fraction(0), True)


@pytest.mark.parametrize("seed", [1])
def test_pruned_and_unpruned_agree(spark, seed):
    edges = random_edges(seed, 9, 0.5)
    for pattern in (2, 3):
        density, members = R.densest({c: 1 for c in R.cliques(edges, pattern)}, R.ids_of(edges))
        for prune_first in (True, False):
            best = densest_subgraph(frame(spark, edges), pattern, prune=prune_first)
            assert (Fraction(best.numer, max(best.denom, 1)), sorted(r[0] for r in best.members.collect())) == (density, members)


def test_two_equal_components_are_both_returned(spark):
    edges = [(a, b) for base in (0, 10) for a in range(base, base + 4) for b in range(a + 1, base + 4)]
    best = densest_subgraph(frame(spark, edges), 3)
    assert (best.numer, best.denom) == (8, 8)
    assert best.members.count() == 8


def test_no_instances_and_no_edges(spark):
    star = frame(spark, [(0, i) for i in range(1, 6)])
    best = densest_subgraph(star, 3)
    assert (best.numer, best.denom, best.members.count()) == (0, 0, 0)
    empty = frame(spark, [])
    assert densest_subgraph(empty, 2).members.count() == 0
    assert cores.core_numbers(empty).count() == 0
    assert components.connected_components(empty).count() == 0


@pytest.mark.parametrize("k", [2, 3, 4, 5])
def test_cliques_against_brute_force(spark, k):
    edges = random_edges(7, 11, 0.6)
    found = frame(spark, edges)
    listed = {tuple(r[0]) for r in cliques.list_cliques(found, k).collect()}
    assert listed == set(R.cliques(edges, k))
    assert cliques.count_cliques(found, k).first()[0] == len(listed)
    degree = {v: sum(v in c for c in listed) for v in R.ids_of(edges)}
    assert pairs(cliques.clique_degrees(found, k, graph.vertices_of(found))) == set(degree.items())
    by_core = cliques.list_cliques(found, k, graph.orient_by_core(found, cores.core_numbers(found)))
    assert {tuple(r[0]) for r in by_core.collect()} == listed


@pytest.mark.parametrize("k", [2, 3])
def test_core_numbers_against_sequential_peeling(spark, k):
    edges = random_edges(11, 12, 0.5)
    expected = R.core_numbers({c: 1 for c in R.cliques(edges, k)}, R.ids_of(edges))
    found = frame(spark, edges)
    inc = cliques.incidence(find_instances(found, k))
    assert pairs(cores.instance_core_numbers(inc, graph.vertices_of(found))) == set(expected.items())
    assert dict(pairs(peel.batch_peel(inc))).items() <= expected.items()
    if k == 2:
        assert pairs(cores.core_numbers(found)) == set(expected.items())
        assert {r[0] for r in cores.fixed_core(inc, 3).collect()} == {v for v, c in expected.items() if c >= 3}
        assert cores.fixed_core(inc, 99).count() == 0


@pytest.mark.parametrize("name", sorted(patterns.PATTERNS))
def test_patterns_against_brute_force(spark, name):
    edges = random_edges(3, 8, 0.55)
    pattern = patterns.PATTERNS[name]
    expected = R.pattern_instances(edges, pattern.size, pattern.edges)
    got = {tuple(r["members"]): r["mult"] for r in patterns.instances(frame(spark, edges), pattern).collect()}
    assert got == expected


def test_counts_without_instances_against_brute_force(spark):
    edges = random_edges(17, 8, 0.6)
    found = cut(frame(spark, edges))
    for pattern in patterns.PATTERNS.values():
        assert patterns.count_matches(found, pattern).first()[0] == sum(R.pattern_instances(edges, pattern.size, pattern.edges).values())


@pytest.mark.parametrize("k", [2, 3, 4])
def test_cliques_through_seeds(spark, k):
    edges = random_edges(18, 12, 0.5)
    for seeds in ([3], [0, 5, 11], [99], []):
        ids = spark.createDataFrame([(v,) for v in seeds], "id bigint")
        got = [tuple(r[0]) for r in cliques.cliques_through(frame(spark, edges), ids, k).collect()]
        assert sorted(got) == sorted(c for c in R.cliques(edges, k) if set(seeds) & set(c))


def test_closed_forms_agree_with_the_matcher(spark):
    edges = frame(spark, random_edges(4, 10, 0.5))
    total = lambda name: patterns.instances(edges, patterns.PATTERNS[name]).agg(F.sum("mult")).first()[0] or 0
    degree = lambda name: pairs(patterns.pattern_degrees(patterns.instances(edges, patterns.PATTERNS[name])))
    assert patterns.tailed_triangle_count(edges).first()[0] == total("tailed-triangle")
    assert patterns.common_edge_triangles_count(edges, 2).first()[0] == total("2-triangle")
    assert patterns.common_edge_triangles_count(edges, 3).first()[0] == total("3-triangle")
    assert patterns.basket_count(edges).first()[0] == total("basket")
    assert patterns.four_cycle_count(edges).first()[0] == total("4-cycle")
    assert patterns.star_count(edges, 3).first()[0] == total("3-star")
    assert pairs(patterns.common_edge_triangles_degrees(edges, 2)) == degree("2-triangle")
    assert pairs(patterns.common_edge_triangles_degrees(edges, 3)) == degree("3-triangle")
    assert pairs(patterns.four_cycle_degrees(edges)) == degree("4-cycle")
    assert {p for p in pairs(patterns.star_degrees(edges, 3)) if p[1]} == degree("3-star")
    assert pairs(patterns.tailed_triangle_degrees(edges)) == degree("tailed-triangle")
    assert pairs(patterns.basket_degrees(edges)) == degree("basket")


@pytest.mark.parametrize("name", ["tailed-triangle", "4-cycle", "4-path"])
def test_instances_of_one_vertex(spark, name):
    edges = random_edges(5, 10, 0.35)
    pattern = patterns.PATTERNS[name]
    expected = {group: n for group, n in R.pattern_instances(edges, pattern.size, pattern.edges).items() if 2 in group}
    got = {tuple(r["members"]): r["mult"] for r in patterns.instances_at(frame(spark, edges), pattern, 2).collect()}
    assert got == expected


def test_components_of_hubs_and_chains(spark):
    """A hub of many leaves at either end of the order, and a chain, with few rows to a slice."""
    edges = [(0, i) for i in range(1, 900)] + [(i, 5000) for i in range(1000, 1900)] + [(i, i + 1) for i in range(6000, 6100)]
    got = dict(pairs(components.connected_components(frame(spark, edges))))
    assert {got[i] for i in range(900)} == {0}
    assert {got[i] for i in [*range(1000, 1900), 5000]} == {1000}
    assert {got[i] for i in range(6000, 6101)} == {6000}


def test_pattern_symmetry():
    assert len(patterns.PATTERNS["4-cycle"].automorphisms()) == 8
    assert len(patterns.PATTERNS["basket"].automorphisms()) == 4
    assert patterns.PATTERNS["4-path"].diameter() == 3
    with pytest.raises(ValueError):
        patterns.Pattern.of(4, [(0, 1), (2, 3)])


def test_densest_by_pattern(spark):
    edges = random_edges(8, 8, 0.6)
    pattern = patterns.PATTERNS["2-triangle"]
    density, members = R.densest(R.pattern_instances(edges, pattern.size, pattern.edges), R.ids_of(edges))
    best = densest_subgraph(frame(spark, edges), "2-triangle")
    assert (Fraction(best.numer, best.denom), sorted(r[0] for r in best.members.collect())) == (density, members)


def test_approximations_keep_their_guarantee(spark):
    edges = random_edges(21, 10, 0.5)
    found = find_instances(frame(spark, edges), 3)
    best, _ = R.densest({c: 1 for c in R.cliques(edges, 3)}, R.ids_of(edges))
    level = approx.peel_by_level(found).first()
    assert best / 3 <= Fraction(level["n_instances"], level["n_vertices"]) <= best
    state = approx.peel_by_vertex(found).first()
    assert best / 3 <= Fraction(state["n_instances"], state["n_vertices"]) <= best
    ids, stats = approx.max_core(found)
    row = stats.first()
    assert (row["n_instances"], row["n_vertices"]) == tuple(approx.members_within(found, ids).select("n_instances", "n_vertices").first())
    top = approx.max_core_top_down(frame(spark, edges), 3, first=2)
    assert {r["id"] for r in top.collect()} == {r["id"] for r in ids.collect()}
    assert approx.share_loads(found, 16).agg(F.max("load") / 16).first()[0] >= float(best)


def test_peel_trace_ends_empty(spark):
    edges = R.edges_of(R.G1)
    expected = R.core_numbers({c: 1 for c in R.cliques(edges, 3)}, R.ids_of(edges))
    found = frame(spark, edges)
    rows = peel.peel_trace(find_instances(found, 3), graph.vertices_of(found)).orderBy("step").collect()
    assert (rows[-1]["remaining_vertices"], rows[-1]["remaining_instances"]) == (0, 0)
    assert {r["id"]: r["core"] for r in rows} == expected
    with pytest.raises(ValueError):
        peel.peel_trace(find_instances(found, 3), most_instances=2)


def test_pruning(spark):
    edges = frame(spark, R.edges_of(R.G3))
    kept, core, figures = prune.densest_core(find_instances(edges, 3))
    assert figures["k_max"] == 3
    assert figures["threshold"] == 1
    covered = prune.covered_edges(edges, kept)
    assert pairs(covered) == {p for c in R.cliques(R.edges_of(R.G3), 3) for p in [(c[0], c[1]), (c[0], c[2]), (c[1], c[2])]}
    instances, comps, best = prune.prune_by_components(kept, core)
    assert Fraction(*best) <= 1 and comps.count() >= 6 and instances.count() >= 6


def test_components(spark):
    edges = [(1, 2), (2, 3), (7, 8), (20, 9), (9, 21), (5, 5)]
    got = pairs(components.connected_components(spark.createDataFrame(edges, EDGES)))
    assert got == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7), (9, 9), (20, 9), (21, 9)}
    chain = [(i, i + 1) for i in range(60)]
    random.Random(1).shuffle(chain)
    assert {r[1] for r in pairs(components.connected_components(spark.createDataFrame(chain, EDGES)))} == {0}
    with pytest.raises(RuntimeError):
        components.connected_components(spark.createDataFrame(chain, EDGES), max_rounds=1)


def test_canonical_edges_and_isolated_vertices(spark):
    raw = spark.createDataFrame([(2, 1), (1, 2), (3, 3), (None, 4), (4, 1)], EDGES)
    edges = graph.canonical_edges(raw)
    assert pairs(edges) == {(1, 2), (1, 4)}
    ids = graph.vertices_of(edges, spark.createDataFrame([(9,)], "id bigint"))
    assert pairs(graph.degrees(edges, ids)) == {(1, 2), (2, 1), (4, 1), (9, 0)}
    assert pairs(cores.core_numbers(edges, ids)) == {(1, 1), (2, 1), (4, 1), (9, 0)}
    assert tuple(graph.graph_counts(edges, ids).first()) == (4, 2, 2)
    assert pairs(graph.dense_ids(ids)) == {(1, 0), (2, 1), (4, 2), (9, 3)}


def test_binomials_stay_exact(spark):
    df = spark.createDataFrame([(0,), (1,), (4,), (2_000_000,)], "n bigint")
    assert [r[0] for r in df.select(binomial(F.col("n"), 3)).collect()] == [0, 0, 4, 2_000_000 * 1_999_999 * 1_999_998 // 6]


def test_beyond_one_task(spark):
    """A 5-clique with a chain of triangles, searched by rounds over all executors."""
    chain = [e for a in range(4, 12) for e in ((a, a + 1), (a, a + 2))]
    edges = frame(spark, [(a, b) for a in range(5) for b in range(a + 1, 5)] + chain)
    best = densest_subgraph(edges, 3, prune=False, most_instances=2)
    assert (best.exact, best.gap, best.numer, best.denom) == (True, 0.0, 10, 5)
    assert sorted(r[0] for r in best.members.collect()) == [0, 1, 2, 3, 4]
    loose = densest_subgraph(edges, 3, prune=False, most_instances=2, max_rounds=1)
    assert 0 <= loose.density <= 2 <= loose.density + loose.gap + 1e-9
    rows = queries.densest_members(3, prune=False, most_instances=2, max_rounds=1)(edges).collect()
    assert {(r["exact"], r["gap"]) for r in rows} == {(loose.exact, loose.gap)}


@pytest.mark.parametrize("seed, pattern, few", [(1, 2, True), (2, 3, False), (3, "2-triangle", True), (4, 2, False), (6, "3-triangle", True)])
def test_balanced_loads_against_brute_force(spark, monkeypatch, seed, pattern, few):
    """Vertices' loads reach instances by a broadcast or by shuffles; patterns of 4 and 5 vertices have several instances a set."""
    monkeypatch.setattr(balance, "FEW_VERTICES", 1000 if few else 0)
    monkeypatch.setattr(balance, "ATTEMPT", 10)
    edges = random_edges(seed, 9, 0.6 if seed < 6 else 0.8)
    found = {c: 1 for c in R.cliques(edges, pattern)} if isinstance(pattern, int) else R.pattern_instances(edges, patterns.PATTERNS[pattern].size, patterns.PATTERNS[pattern].edges)
    density, members = R.densest(found, R.ids_of(edges))
    got = balance.balanced_densest(find_instances(frame(spark, edges), pattern))
    assert got.proved and Fraction(got.numer, got.denom) == density and got.upper == float(density)
    assert sorted(r[0] for r in got.members.collect()) == members


def test_prices_prove_in_few_rounds(spark):
    """A random graph with a tail of vertices whose edges nearly all have to give everything to them."""
    rng = random.Random(5)
    edges = [(a, b) for a in range(60) for b in range(a + 1, 60) if rng.random() < 0.4] + [(60 + i, j) for i in range(12) for j in rng.sample(range(60), 12 + i % 3)]
    found = find_instances(frame(spark, edges), 2)
    got = balance.balanced_densest(found)
    assert got.proved and got.rounds < 20
    whole = densest_subgraph(frame(spark, edges), 2, many=0)
    small = densest_subgraph(frame(spark, edges), 2, many=None)
    assert (whole.exact, whole.numer, whole.denom) == (True, small.numer, small.denom) == (True, got.numer, got.denom)
    assert pairs(whole.members) == pairs(small.members) == pairs(got.members)


@pytest.mark.parametrize("k", [2, 3])
def test_components_are_balanced_in_tasks(spark, monkeypatch, k):
    """Two equal parts, a thinner one and single triangles; no job of many rounds runs for any of them."""

    def never(*_):
        raise AssertionError("balanced over all executors")

    cliques_of = [(a + base, b + base) for base in (0, 20) for a in range(6) for b in range(a + 1, 6)] + [(5, 6), (6, 7), (5, 7)]
    edges = cliques_of + random_edges(21, 9, 0.5) + [(a + 50, b + 50) for a, b in random_edges(22, 9, 0.4)] + [(100, 101), (101, 102), (100, 102)]
    small = densest_subgraph(frame(spark, edges), k, many=None)
    monkeypatch.setattr(densest, "balanced_densest", never)
    whole = densest_subgraph(frame(spark, edges), k, many=0)
    assert (whole.exact, whole.gap, whole.numer, whole.denom) == (True, 0.0, small.numer, small.denom)
    assert pairs(whole.members) == pairs(small.members)


def test_components_too_large_for_a_task(spark, monkeypatch):
    """The large part is denser, or less dense, than the small one."""
    monkeypatch.setattr(densest, "ONE_WORKER", 12)
    for left, right in ((6, 4), (5, 6)):
        sides = [(a, b) for a in range(left) for b in range(10, 10 + right)]
        edges = sides + [(a, b) for a in range(30, 35) for b in range(a + 1, 35)]
        whole, small = (densest_subgraph(frame(spark, edges), 2, many=m) for m in (0, None))
        assert (whole.exact, whole.numer, whole.denom) == (True, small.numer, small.denom)
        assert pairs(whole.members) == pairs(small.members)


@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_prices_in_a_task_against_minimum_cuts(k):
    proved = 0
    for seed in range(40):
        rng = random.Random(seed)
        groups = list(combinations(range(0, 7 * rng.randint(k, 10), 7), k))
        groups = rng.sample(groups, rng.randint(1, len(groups)))
        mults = [rng.choice([1, 1, 2, 5, 10**9]) for _ in groups]
        chosen, density, _ = densest_set(groups, mults)
        for start, expected in ((Fraction(0), chosen), (density, chosen), (density + Fraction(1, 10**6), [])):
            ids, numer, denom, exact = densest_by_price(np.array(groups), np.array(mults), start)
            if exact:
                assert sorted(ids.tolist()) == sorted(expected)
                assert not expected or Fraction(numer, denom) == density
                proved += 1
    assert proved > 60


def test_densest_prefix_that_doubles_cannot_tell():
    n = 3 * 10**15
    assert longest_densest(np.cumsum(np.array([n, n + 1, n, n]))) == (2 * n + 1, 2)
    assert longest_densest(np.cumsum(np.array([2, 2, 2, 1]))) == (6, 3)


def test_dense_part_holds_the_densest_set(spark):
    edges = [(a, b) for a in range(6) for b in range(a + 1, 6)] + [(5, 6), (6, 7), (7, 8), (6, 8)]
    kept = prune.dense_part(find_instances(frame(spark, edges), 2))
    assert sorted(tuple(r["members"]) for r in kept.collect()) == sorted(e for e in edges if max(e) < 6)


def test_balanced_loads_of_nothing(spark):
    got = balance.balanced_densest(find_instances(frame(spark, [(0, 1)]), 3))
    assert (got.numer, got.denom, got.proved, got.upper, got.members.count()) == (0, 0, True, 0.0, 0)


def test_balanced_loads_of_two_equal_parts(spark):
    edges = [(a, b) for base in (0, 10) for a in range(base, base + 4) for b in range(a + 1, base + 4)] + [(3, 10)]
    best = densest_subgraph(frame(spark, edges), 3, most_instances=0)
    assert (best.numer, best.denom, best.exact, best.members.count()) == (8, 8, True, 8)


def test_large_and_small_components_together(spark):
    """The small component is denser, as dense, or less dense than the large one."""
    ladder = [e for a in range(100, 112) for e in ((a, a + 1), (a, a + 2))]
    clique = [(a, b) for a in range(5) for b in range(a + 1, 5)]
    best = densest_subgraph(frame(spark, ladder + clique), 2, prune=False, most_instances=15)
    assert (best.numer, best.denom, best.exact) == (10, 5, True)
    twins = [(a + 20, b + 20) for a, b in clique] + [(24, 40)] + [(40 + i, 41 + i) for i in range(8)]
    best = densest_subgraph(frame(spark, twins + clique), 2, prune=False, most_instances=15)
    assert (best.numer, best.denom, best.exact, best.members.count()) == (20, 10, True, 10)


def test_threshold_of_longer_lists(spark):
    """The fold over sorted shares agrees with trying all subsets."""
    rng = random.Random(6)
    rows = [(*[rng.uniform(-1, 2) for _ in range(4)], *[rng.choice([1.0, 0.5, 0.25]) for _ in range(4)]) for _ in range(50)]
    df = spark.createDataFrame(rows, ", ".join(f"a{j} double" for j in range(4)) + ", " + ", ".join(f"c{j} double" for j in range(4)))
    shares, scale = [F.col(f"a{j}") for j in range(4)], [F.col(f"c{j}") for j in range(4)]
    padded = balance.threshold([*shares, F.lit(-1e9)], [*scale, F.lit(1.0)], F.lit(1.0))
    for row in df.select(balance.threshold(shares, scale, F.lit(1.0)).alias("all"), padded.alias("sorted")).collect():
        assert abs(row["all"] - row["sorted"]) < 1e-9


@pytest.mark.parametrize("s, few", [(2, True), (2, False), (3, True)])
def test_star_cores_against_sequential_peeling(spark, monkeypatch, s, few):
    monkeypatch.setattr(closed_cores, "FEW_VERTICES", 1000 if few else 0)
    edges = random_edges(13, 9, 0.45) + [(20, i) for i in range(21, 26)]
    pattern = patterns.star(s)
    expected = R.core_numbers(R.pattern_instances(edges, pattern.size, pattern.edges), R.ids_of(edges))
    assert pairs(closed_cores.star_cores(frame(spark, edges), s)) == {(v, c) for v, c in expected.items() if c}


@pytest.mark.parametrize("seed", [14, 15])
def test_four_cycle_cores_against_sequential_peeling(spark, seed):
    edges = random_edges(seed, 9, 0.5)
    pattern = patterns.PATTERNS["4-cycle"]
    expected = R.core_numbers(R.pattern_instances(edges, pattern.size, pattern.edges), R.ids_of(edges))
    assert pairs(closed_cores.four_cycle_cores(frame(spark, edges))) == {(v, c) for v, c in expected.items() if c}


def test_cores_of_many_vertices_recompute_only_what_falls(spark, monkeypatch):
    monkeypatch.setattr(cores, "FEW_VERTICES", 0)
    edges = random_edges(16, 14, 0.4)
    found = frame(spark, edges)
    for k in (2, 3):
        expected = R.core_numbers({c: 1 for c in R.cliques(edges, k)}, R.ids_of(edges))
        got = cores.core_numbers(found) if k == 2 else cores.instance_core_numbers(cliques.incidence(find_instances(found, 3)), graph.vertices_of(found))
        assert pairs(got) == set(expected.items())


def test_densities_that_doubles_cannot_tell_apart(spark):
    rows = [(10**17, 10**17 - 1), (10**17 + 1, 10**17), (3, 4)]
    assert prune.densest_row(spark.createDataFrame(rows, "numer bigint, denom bigint")) == Fraction(10**17, 10**17 - 1)
    assert prune.densest_row(spark.createDataFrame([], "numer bigint, denom bigint")) is None


def test_tiny_components_are_dealt_to_tasks_by_their_number(spark, monkeypatch):
    """Many components of few bytes keep all tasks busy; adaptive execution used to merge them into a task or two."""
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    shapes = [[(0, 1)], [(0, 1), (1, 2)], [(0, 1), (1, 2), (0, 2), (2, 3)], [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3), (3, 4), (4, 5)]]
    edges = [(10 * c + a, 10 * c + b) for c in range(600) for a, b in shapes[c % 4]]
    found = find_instances(frame(spark, edges), 2)
    parts = cut(prune.instance_components(found))
    for start, most_cuts in ((Fraction(0), None), (Fraction(1), None), (Fraction(1), 1)):
        expected = set()
        for c in range(600):
            own = [[10 * c + a, 10 * c + b] for a, b in shapes[c % 4]]
            chosen, density, certain = densest_set(own, [1] * len(own), start, most_cuts)
            expected |= {(10 * c, v, int(density * len(chosen)), len(chosen), certain) for v in chosen}
        solved = solve_components(found, parts, (start.numerator, start.denominator), most_cuts)
        assert solved.rdd.getNumPartitions() >= 20
        assert pairs(solved) == expected
    whole = densest_subgraph(frame(spark, edges), 2)
    assert (whole.numer, whole.denom, whole.exact) == (6 * 150, 4 * 150, True)
