"""Undirected simple graphs as frames: edges (src, dst) with src < dst, and vertices (id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corelith.plans.session import cut, partitions

EDGES = "src bigint, dst bigint"
VERTICES = "id bigint"


def canonical_edges(raw: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Each undirected edge once with src < dst; nulls and self-loops go."""
    a, b = F.col(src).cast("bigint"), F.col(dst).cast("bigint")
    return raw.filter(a != b).select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).distinct()


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of each edge as (u, v)."""
    pairs = F.array(F.struct(F.col("src").alias("u"), F.col("dst").alias("v")), F.struct(F.col("dst").alias("u"), F.col("src").alias("v")))
    return edges.select(F.explode(pairs).alias("e")).select("e.u", "e.v")


def vertices_of(edges: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """End points of edges and, where given, declared ids, which may be isolated."""
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    if declared is not None:
        ids = ids.unionByName(declared.select(F.col("id").cast("bigint").alias("id")))
    return ids.distinct()


def degrees(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(id, degree); isolated vertices count 0 when ``vertices`` has them."""
    counted = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    if vertices is None:
        return counted
    return vertices.join(counted, "id", "left").select("id", F.coalesce("degree", F.lit(0).cast("bigint")).alias("degree"))


def side_by_side(one: DataFrame, other: DataFrame) -> DataFrame:
    """The columns of two frames of one row each, in one row, without a join."""
    names = [*one.columns, *other.columns]
    both = one.unionByName(other, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in names])


def graph_counts(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """One row: n_vertices, n_edges, max_degree."""
    deg = degrees(edges, vertices)
    return deg.agg(
        F.count(F.lit(1)).alias("n_vertices"),
        F.call_function("div", F.coalesce(F.sum("degree"), F.lit(0)).cast("bigint"), F.lit(2).cast("bigint")).alias("n_edges"),
        F.coalesce(F.max("degree"), F.lit(0)).alias("max_degree"),
    )


def orient(edges: DataFrame) -> DataFrame:
    """(u, v) from the end of smaller (degree, id) to the other, so out-degrees stay below the square root of 2m."""
    deg = degrees(edges)
    by = lambda end: deg.select(F.col("id").alias(end), F.col("degree").alias(f"d_{end}"))
    ends = edges.join(by("src"), "src").join(by("dst"), "dst")
    first = F.struct("d_src", "src") < F.struct("d_dst", "dst")
    return ends.select(F.when(first, F.col("src")).otherwise(F.col("dst")).alias("u"), F.when(first, F.col("dst")).otherwise(F.col("src")).alias("v"))


def orient_by_core(edges: DataFrame, cores: DataFrame) -> DataFrame:
    """The same by (core, id), for graphs whose hubs lie in sparse parts."""
    by = lambda end: cores.select(F.col("id").alias(end), F.col("core").alias(f"c_{end}"))
    ends = edges.join(by("src"), "src").join(by("dst"), "dst")
    first = F.struct("c_src", "src") < F.struct("c_dst", "dst")
    return ends.select(F.when(first, F.col("src")).otherwise(F.col("dst")).alias("u"), F.when(first, F.col("dst")).otherwise(F.col("src")).alias("v"))


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ``ids`` (id)."""
    keep = ids.select("id").distinct()
    return edges.join(keep.withColumnRenamed("id", "src"), "src", "left_semi").join(
        keep.withColumnRenamed("id", "dst"), "dst", "left_semi"
    ).select("src", "dst")


def closed_neighbourhood(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id): ``ids`` and all their neighbours."""
    around = symmetric(edges).join(ids.select(F.col("id").alias("u")), "u", "left_semi").select(F.col("v").alias("id"))
    return ids.select("id").unionByName(around).distinct()


def ball(edges: DataFrame, ids: DataFrame, radius: int) -> DataFrame:
    """(id): everything within ``radius`` steps of ``ids``; the ego network's vertices for a single id."""
    for _ in range(radius):
        ids = closed_neighbourhood(edges, ids)
    return ids


def dense_ids(vertices: DataFrame) -> DataFrame:
    """(id, dense_id) with ids numbered from 0 in ascending order, by range partitions and their sizes."""
    spark = vertices.sparkSession
    placed = cut(
        vertices.select("id")
        .distinct()
        .repartitionByRange(partitions(spark), "id")
        .sortWithinPartitions("id")
        .select("id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place"))
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    starts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return placed.join(starts, "part").select("id", (F.col("start") + F.col("place")).alias("dense_id"))


def sorted_adjacency(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(u, neighbours) with ascending neighbour lists; empty lists for isolated vertices."""
    lists = symmetric(edges).groupBy("u").agg(F.sort_array(F.collect_list("v")).alias("neighbours"))
    if vertices is None:
        return lists
    return vertices.select(F.col("id").alias("u")).join(lists, "u", "left").select("u", F.coalesce("neighbours", F.array().cast("array<bigint>")).alias("neighbours"))
