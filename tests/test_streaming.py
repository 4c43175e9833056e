from __future__ import annotations

from datetime import datetime

from corelith.streaming import densest_by_window, window_edges

ROWS = [
    (datetime(2024, 1, 1, 0, 5), 1, 2),
    (datetime(2024, 1, 1, 0, 6), 2, 3),
    (datetime(2024, 1, 1, 0, 7), 3, 1),
    (datetime(2024, 1, 1, 0, 8), 2, 1),
    (datetime(2024, 1, 1, 1, 5), 1, 2),
    (datetime(2024, 1, 1, 1, 6), 7, 7),
]
SCHEMA = "ts timestamp, src bigint, dst bigint"


def test_windows_of_a_table(spark):
    edges = window_edges(spark.createDataFrame(ROWS, SCHEMA))
    assert edges.count() == 4
    got = [(r["numer"], r["denom"]) for r in densest_by_window(edges, 3).orderBy("window_start").collect()]
    assert got == [(1, 3), (0, 0)]


def test_windows_are_solved_apart(spark):
    """The same ids in two windows; two separate sets of one density make one answer."""
    hour = lambda h, edges: [(datetime(2024, 1, 1, h, 5), a, b) for a, b in edges]
    clique = [(a, b) for a in range(4) for b in range(a)]
    rows = hour(0, clique) + hour(1, [(0, 1), (1, 2), (2, 0)]) + hour(2, [(0, 1), (1, 2), (2, 0), (7, 8), (8, 9), (9, 7), (2, 3)])
    got = densest_by_window(window_edges(spark.createDataFrame(rows, SCHEMA)), 3).orderBy("window_start").collect()
    assert [(r["numer"], r["denom"]) for r in got] == [(4, 4), (1, 3), (2, 6)]


def test_windows_of_a_stream(spark, tmp_path):
    late = [(datetime(2024, 1, 2, 0, 0), 8, 9), (datetime(2024, 1, 2, 0, 1), 8, 9)]
    spark.createDataFrame(ROWS + late, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    seen = []
    query = (
        window_edges(stream)
        .writeStream.option("checkpointLocation", str(tmp_path / "state"))
        .foreachBatch(lambda batch, _: seen.extend((r["numer"], r["denom"]) for r in densest_by_window(batch, 3).orderBy("window_start").collect()))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(120)
    assert seen == [(1, 3), (0, 0)]
