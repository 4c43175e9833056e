from __future__ import annotations

import random

import numpy as np
import pytest

from corelith.operators import components, prune
from corelith.operators.cliques import as_columns
from corelith.operators.components import connected_components, contracted_components, stars
from corelith.plans import densest
from corelith.plans.densest import densest_subgraph, find_instances
from tests.test_graph import frame, pairs, random_edges

PARTS = [(a + base, b + base) for base in (0, 20) for a in range(6) for b in range(a + 1, 6)] + [(50, 51), (51, 52), (50, 52)]


@pytest.mark.parametrize("k", [2, 3])
def test_very_many_cliques_are_neither_listed_nor_contracted_by_stars(spark, monkeypatch, k):
    """Both cost several passes of all instances each, which densest_edges_parts and densest_triangles_parts have no time for."""

    def never(*_):
        raise AssertionError("a form or a pass too many")

    small = densest_subgraph(frame(spark, PARTS), k, many=None)
    for module, name in ((densest, "identified"), (densest, "instance_components"), (prune, "connected_components"), (components, "connected_components")):
        monkeypatch.setattr(module, name, never)
    whole = densest_subgraph(frame(spark, PARTS), k, many=0)
    assert (whole.exact, whole.numer, whole.denom) == (True, small.numer, small.denom)
    assert pairs(whole.members) == pairs(small.members)


@pytest.mark.parametrize("rows, few", [(10**6, 10**6), (7, 10**6), (7, 0)])
def test_components_of_instances_against_stars(spark, monkeypatch, rows, few):
    """Sparse graphs, of which two links of each vertex leave parts that only the pass over all instances joins."""
    monkeypatch.setattr(components, "TASK_ROWS", rows)
    monkeypatch.setattr(prune, "FEW_VERTICES", few)
    rng = random.Random(3)
    chain = list(range(200, 260))
    rng.shuffle(chain)
    edges = sorted({tuple(sorted(e)) for e in [*random_edges(4, 60, 0.03), *zip(chain, chain[1:], strict=False), (500, 501), *((300, i) for i in range(301, 320))]})
    found = find_instances(frame(spark, edges), 2)
    held, sizes = prune.placed(as_columns(found, 2))
    expected = dict(pairs(connected_components(frame(spark, edges))))
    assert {(r["v0"], r["v1"]): r["component"] for r in held.collect()} == {(a, b): expected[a] for a, b in edges}
    count = lambda c: (sum(x == c for x in expected.values()), sum(expected[a] == c for a, _ in edges))
    assert {tuple(r) for r in sizes.select("component", "n_vertices", "n_instances", "rows").collect()} == {(c, *count(c), count(c)[1]) for c in set(expected.values())}
    assert dict(pairs(contracted_components(frame(spark, edges)))) == expected


def test_links_that_leave_parts_to_be_joined(spark):
    """Two fans whose centres are neither the smallest nor the largest neighbour of each other."""
    fan = lambda centre, low, high: [(centre, low), (centre, high), (low, low + 1), (high, high + 1)]
    edges = [tuple(sorted(e)) for e in [*fan(50, 1, 90), *fan(60, 3, 95), (50, 60)]]
    held, sizes = prune.placed(as_columns(find_instances(frame(spark, edges), 2), 2))
    assert {r["component"] for r in held.collect()} == {1}
    assert [(r["component"], r["n_vertices"], r["rows"]) for r in sizes.collect()] == [(1, 10, 9)]


def test_stars_of_long_chains():
    rng = np.random.default_rng(1)
    ids = rng.permutation(5000) * 7 - 9000
    got, low = stars(ids[:-1], ids[1:])
    assert got.tolist() == sorted(ids.tolist()) and set(low.tolist()) == {int(ids.min())}
