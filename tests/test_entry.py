"""Every registered graph query against its SQL, on the smallest tables, where these exist."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__
from corelith.oracles import ORACLES
from corelith.queries import QUERIES
from tests import reference_graphs as R

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
#: Many rounds over a graph that is dense in the smallest tables; TEST_ALL=1 runs them, too.
SLOW = {
    "densest_four_cycles",
    "densest_two_triangles",
    "pattern_four_cycle_core",
    "pattern_four_cycle_core_click",
    "densest_triangles_follow",
    "pattern_four_cycle_peel",
    "pattern_star2_core",
    "pattern_star2_peel",
    "triangle_core_batch",
    "max_core_top_down",
}
CHECKED = sorted(ORACLES if os.environ.get("TEST_ALL") else set(ORACLES) - SLOW)


def test_registry():
    assert set(ORACLES) <= set(QUERIES) <= set(__spark_entry__.queries())
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql())


@needs_tables
def test_flagship(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and rows[0]["denom"] == len(rows)


@needs_tables
@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, name):
    db = duckdb.connect()
    for table in ("events", "lineitem", "nation"):
        db.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    oracle = db.sql(ORACLES[name])
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(oracle.columns)
    assert sorted(map(str, map(tuple, got.select(*oracle.columns).collect()))) == sorted(map(str, oracle.fetchall()))


def test_whole_order_table_by_brute_force(spark, tmp_path):
    orders = {1: [1, 2, 3, 4, 5], 2: [5, 6], 3: [6, 7], 13: [7, 8, 8], 14: [9]}
    rows = [(key, part) for key, held in orders.items() for part in held]
    spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint").write.parquet(str(tmp_path / "lineitem.parquet"))
    run = lambda name: sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect()))
    edges = sorted({(a, b) for held in orders.values() for a in held for b in held if a < b})
    three = R.cliques(edges, 3)
    assert run("graph_parts_edges") == edges
    assert run("triangles") == three
    assert run("triangle_count") == [(len(three),)]
    assert run("source_vertex_ids") == [(v,) for v in range(1, 9)]


def test_report_of_a_small_graph(spark):
    from corelith.operators.graph import canonical_edges
    from corelith.plans.densest import report
    from corelith.plans.session import ship

    ship(spark)
    edges = [(a, b) for a in range(5) for b in range(a)] + [(4, 5), (5, 6), (6, 4), (6, 7)]
    row = report(canonical_edges(spark.createDataFrame(edges, "src bigint, dst bigint")), 3).first()
    assert (row["n_instances"], row["k_max"]) == (11, 6)
    assert (row["numer"], row["denom"], row["exact"], row["gap"]) == (10, 5, True, 0.0)
