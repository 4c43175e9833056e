from __future__ import annotations

from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from corelith.operators import cliques, patterns, prune, wedges
from tests import reference_graphs as R
from tests.test_graph import frame, pairs, random_edges

#: Ids as they are, negative, and beyond 32 bits.
NAMED = {"small": lambda v: v, "negative": lambda v: 7 - v, "wide": lambda v: v * 3_000_000_007 - (1 << 40)}


@pytest.mark.parametrize("name", NAMED)
def test_closing_against_brute_force(spark, monkeypatch, name):
    monkeypatch.setattr(wedges, "AT_ONCE", 40)
    monkeypatch.setattr(wedges, "SLICES", 2)
    own = NAMED[name]
    hub = [(100, v) for v in range(40)]
    edges = sorted({tuple(sorted((own(a), own(b)))) for a, b in [*random_edges(3, 40, 0.25), *hub, (200, 201)]})
    listed = R.cliques(edges, 3)
    held = Counter(p for c in listed for p in combinations(c, 2))
    data = frame(spark, edges)
    assert {tuple(r["members"]) for r in cliques.list_cliques(data, 3).collect()} == set(listed)
    assert cliques.list_cliques(data, 3).count() == cliques.count_cliques(data, 3).first()[0] == len(listed)
    assert {tuple(r) for r in patterns.codegrees(data).collect()} == {(a, b, held[a, b]) for a, b in edges}
    assert pairs(prune.edges_in_triangles(data)) == set(held)
    assert dict(map(tuple, cliques.clique_degrees(data, 3).collect())) == Counter(v for c in listed for v in c)
    assert cliques.count_cliques(data, 5).first()[0] == len(R.cliques(edges, 5))


def test_no_edges_and_no_triangles(spark):
    for edges in ([], [(1, 2)], [(1, 2), (2, 3), (3, 4)]):
        data = frame(spark, edges)
        assert cliques.count_cliques(data, 3).first()[0] == 0
        assert {tuple(r) for r in patterns.codegrees(data).collect()} == {(*e, 0) for e in edges}


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lists_travel_by_cell_and_not_by_edge(spark):
    data = frame(spark, random_edges(5, 60, 0.3))
    for found in (cliques.count_cliques(data, 3), cliques.clique_degrees(data, 3), patterns.codegrees(data), prune.edges_in_triangles(data)):
        assert "array_intersect" not in plan(found) and plan(found).count("MapInArrow") == 1
    lists = cliques._closed_edges(data).agg(F.count(F.lit(1)))
    assert plan(lists).count("collect_list") == 1


@pytest.mark.parametrize("name", ["tailed-triangle", "2-triangle", "3-triangle", "basket"])
def test_matches_start_at_triangles(spark, name):
    edges = random_edges(8, 14, 0.4)
    pattern = patterns.PATTERNS[name]
    found = patterns.count_matches(frame(spark, edges), pattern)
    assert found.first()[0] == sum(R.pattern_instances(edges, pattern.size, pattern.edges).values())
    assert "MapInArrow" in plan(found)
    if name == "tailed-triangle":
        assert "neighbours" not in plan(found)


def test_cliques_through_many_vertices_send_no_list_by_edge(spark, monkeypatch):
    """Every third vertex, whose neighbours are nearly all vertices, and a single one."""
    edges = random_edges(9, 40, 0.25)
    data = frame(spark, edges)
    for few in (10**6, 0):
        monkeypatch.setattr(cliques, "FEW_VERTICES", few)
        for seeds in (set(range(0, 40, 3)), {7}, {99}, set()):
            ids = spark.createDataFrame([(v,) for v in seeds], "id bigint")
            for k in (3, 4):
                found = cliques.cliques_through(data, ids, k)
                assert sorted(tuple(r["members"]) for r in found.collect()) == sorted(c for c in R.cliques(edges, k) if seeds & set(c))
                assert "MapInArrow" in plan(found) and (k > 3 or "array_intersect" not in plan(found))
