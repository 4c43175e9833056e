from __future__ import annotations

from collections import Counter

import pytest

from corelith.operators import graph
from corelith.operators.patterns import PATTERNS
from corelith.sources import tables, text


def pairs(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("head", ["5 3", "5"])
def test_adjacency_list(spark, tmp_path, head):
    path = tmp_path / "graph.txt"
    path.write_bytes(f"{head}\r\n0 1 2 2 0\r\n1 0  \r\n2 0 1\n\n".encode())
    edges, vertices = text.read_adjacency(spark, str(path))
    assert pairs(edges) == {(0, 1), (0, 2), (1, 2)}
    assert pairs(vertices) == {(0,), (1,), (2,), (3,), (4,)}


def test_adjacency_of_several_files(spark, tmp_path):
    """The last file is the largest and is read first; a body line has the header's text."""
    (tmp_path / "graph").mkdir()
    names = ["part-00000", "part-00001", "part-00002"]
    texts = ["\n7 6\n0 1", "1 0 2\n2 1 3", "".join(f"3 2 4{' ' * 500}\n" for _ in range(40)) + "7 6\n6 7\n4 3 5\n5 4\n"]
    for name, text_of in zip(names, texts, strict=True):
        (tmp_path / "graph" / name).write_text(text_of)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "100"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            edges, vertices = text.read_adjacency(spark, str(tmp_path / "graph"))
            assert pairs(edges) == {(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (6, 7)}
            assert pairs(vertices) == {(v,) for v in range(8)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_round_trip_of_skewed_files(spark, tmp_path, caplog):
    """A hub's line makes one of many files far larger than the first."""
    hub = [(400, v) for v in range(400)] + [(v, v + 1) for v in range(0, 390, 3)]
    edges = graph.canonical_edges(spark.createDataFrame(hub, "src bigint, dst bigint"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        text.write_adjacency(edges, graph.vertices_of(edges), str(tmp_path / "out"))
        assert len(list((tmp_path / "out").glob("part-*"))) > 2
        again, ids = text.read_adjacency(spark, str(tmp_path / "out"))
        assert pairs(again) == pairs(edges)
        assert pairs(ids) == {(v,) for v in range(401)}
        assert not caplog.records
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "2")


def test_empty_file(spark, tmp_path):
    path = tmp_path / "none.txt"
    path.write_text("")
    edges, vertices = text.read_adjacency(spark, str(path))
    assert edges.count() == vertices.count() == 0


def test_edge_list_and_dense_ids(spark, tmp_path):
    path = tmp_path / "edges.txt"
    path.write_text("# comment\n10\t20\n20 10\n 30   10\n40 40\n")
    edges, vertices = text.read_edge_list(spark, str(path))
    assert pairs(edges) == {(10, 20), (10, 30)}
    assert pairs(vertices) == {(10,), (20,), (30,), (40,)}
    moved, mapping = text.densified(edges, vertices)
    assert pairs(moved) == {(0, 1), (0, 2)}
    assert pairs(mapping) == {(10, 0), (20, 1), (30, 2), (40, 3)}


def test_matrix(spark, tmp_path):
    path = tmp_path / "matrix.txt"
    path.write_text("[[0, 1, 0],\n [1, 0, 1],\n [0, 1, 0]]\n")
    edges, vertices = text.read_matrix(spark, str(path))
    assert pairs(edges) == {(0, 1), (1, 2)}
    assert vertices.count() == 3


def test_pattern_file():
    assert text.read_pattern("4 8 1\n0 1\n1 2\n2 3\n3 0\n") == PATTERNS["4-cycle"]


def test_round_trip(spark, tmp_path):
    edges = graph.canonical_edges(spark.createDataFrame([(0, 1), (2, 1), (4, 0)], "src bigint, dst bigint"))
    vertices = graph.vertices_of(edges, spark.range(6))
    text.write_adjacency(edges, vertices, str(tmp_path / "out"))
    again, ids = text.read_adjacency(spark, str(tmp_path / "out"))
    assert pairs(again) == pairs(edges)
    assert pairs(ids) == pairs(vertices)


def test_consecutive_edges_across_blocks(spark):
    ids = [3, 1, 1, 2, 3, 5, 4, 4, 2]
    steps = spark.createDataFrame([(i * 7, v) for i, v in enumerate(ids)], "at bigint, id bigint")
    expected = {(min(a, b), max(a, b)) for a, b in zip(ids, ids[1:], strict=False) if a != b}
    for span in (1, 10, 1000):
        assert pairs(tables.consecutive_edges(steps, span)) == expected


def test_a_run_over_a_file(spark, tmp_path, caplog):
    from corelith.__main__ import run

    lines = ["7"] + [" ".join(map(str, [v, *[w for w in range(5) if w != v]])) for v in range(5)] + ["5 4 6", "6 5"]
    (tmp_path / "graph.txt").write_text("\n".join(lines))
    with caplog.at_level("INFO"):
        got = run(spark, str(tmp_path / "graph.txt"), out=str(tmp_path / "out"))
    assert got["graph"] == {"n_vertices": 7, "n_edges": 12, "max_degree": 5}
    assert got["answer"] == {"density": 2.0, "numer": 10, "denom": 5, "members": 5, "exact": True, "gap": 0.0}
    assert got["figures"]["n_instances"] == 10 and got["figures"]["k_max"] == 6
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["0", "1", "2", "3", "4"]
    assert {"read", "instances", "cores", "search", "total"} <= set(got["seconds"])
    assert "search" in caplog.text


def test_parts_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    """A task holds no more lines and pairs on larger tables; adaptive execution used to merge them into a few tasks."""
    from corelith.plans import session

    monkeypatch.setattr(session, "TASK_ROWS", 100)
    lines = [(order, order * step % 97) for order in range(500) for step in (1, 5, 7, 7)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint").write.parquet(str(tmp_path / "lineitem.parquet"))
    orders = [sorted({p for o, p in lines if o == order}) for order in range(500)]
    times = Counter((a, b) for parts in orders for a in parts for b in parts if a < b)
    for least in (1, 2, 3):
        edges = tables.bought_together_edges(spark, str(tmp_path), least)
        assert {tuple(r) for r in edges.collect()} == {pair for pair, n in times.items() if n >= least}
        assert edges.rdd.getNumPartitions() >= 20


def test_a_file_is_parsed_once_for_its_edges(spark, tmp_path):
    """Edges of a file that declares their number are counted and returned from one parse; lists are built in the ranges they are written in."""
    made = [(a, b) for a in range(40) for b in range(a + 1, 40) if (a * b) % 7 == 3]
    edges = spark.createDataFrame(made, "src bigint, dst bigint")
    path = str(tmp_path / "graph")
    text.write_adjacency(edges, graph.vertices_of(edges, spark.range(50)), path)
    found, vertices = text.read_adjacency(spark, path)
    assert pairs(found) == set(made)
    assert pairs(vertices) == {(v,) for v in range(50)}
    scanned = found._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in scanned and "FileScan text" not in scanned
