"""The registered graph queries. Each takes (spark, sf_dir) and works on graphs derived from the tables there.

click: users of consecutive click events; follow: users of consecutive events of any type; parts: parts in the same
order; part2x: parts together in at least two orders. All read their whole tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corelith.functions import binomial
from corelith.operators import approx, bounds, cliques, closed_cores, components, cores, graph, patterns, peel, prune
from corelith.plans.densest import densest_subgraph, find_instances, report
from corelith.plans.session import cut, partitions, shared_path, ship, stored
from corelith.sources import tables, text

Query = Callable[[SparkSession, str], DataFrame]


def click(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.next_user_edges(spark, sf_dir, "click")


def follow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.next_user_edges(spark, sf_dir, None)


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.bought_together_edges(spark, sf_dir)


def part2x(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.bought_together_edges(spark, sf_dir, least_orders=2)


@dataclass(frozen=True)
class on:  # noqa: N801
    """The query that applies ``of`` to the graph of ``source``."""

    source: Query
    of: Callable[[DataFrame], DataFrame]

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.of(self.source(spark, sf_dir))


def as_columns(found: DataFrame, k: int) -> DataFrame:
    """Members as columns v0..v{k-1}, as arrays differ between engines."""
    more = [c for c in found.columns if c != "members"]
    return found.select(*[F.col("members")[i].alias(f"v{i}") for i in range(k)], *more)


def dense_edges(edges: DataFrame) -> DataFrame:
    return text.densified(edges, graph.vertices_of(edges))[0]


def adjacency_text(edges: DataFrame) -> DataFrame:
    return text.adjacency_lines(edges, graph.vertices_of(edges))


def adjacency_file(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges and vertices read back from an adjacency-list file in the shared folder."""
    spark, path = edges.sparkSession, shared_path(edges.sparkSession, "adjacency")
    edges = cut(edges)
    text.write_adjacency(edges, graph.vertices_of(edges), path)
    return text.read_adjacency(spark, path)


def edge_list_file(edges: DataFrame) -> DataFrame:
    """Edges read back from a file that holds every edge in both directions below a comment."""
    spark, path = edges.sparkSession, shared_path(edges.sparkSession, "edges")
    lines = graph.symmetric(edges).select(F.concat_ws("\t", F.col("u").cast("string"), F.col("v").cast("string")).alias("value"))
    spark.createDataFrame([("# both directions",)], "value string").unionByName(lines).write.text(path)
    return text.read_edge_list(spark, path)[0]


def nation_matrix_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of one region as neighbours, read back from the file of their adjacency matrix."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("region"))
    by_id = F.sort_array(F.collect_list(F.struct("id", "region")))
    listed = nation.agg(by_id.alias("all"))  # 25 nations
    bit = lambda x: lambda y: F.when((x["region"] == y["region"]) & (x["id"] != y["id"]), "1").otherwise("0")
    rows = F.transform("all", lambda x: F.array_join(F.transform("all", bit(x)), " "))
    path = shared_path(spark, "matrix")
    listed.select(F.array_join(rows, "\n").alias("value")).coalesce(1).write.text(path)
    return text.read_matrix(spark, path)[0]


def file_pattern_count(edges: DataFrame) -> DataFrame:
    """Instances of the pattern that a pattern file describes: a cycle of four."""
    spark, path = edges.sparkSession, shared_path(edges.sparkSession, "pattern")
    spark.createDataFrame([("4 8 1\n0 1\n1 2\n2 3\n3 0",)], "value string").coalesce(1).write.text(path)
    lines = spark.read.text(path, wholetext=True).first()[0]
    found = patterns.instances(edges, text.read_pattern(lines))
    return found.agg(F.coalesce(F.sum("mult"), F.lit(0)).cast("bigint").alias("n_instances"))


def placed_by_core(edges: DataFrame) -> DataFrame:
    """(id, core, place): vertices from high to low core, numbered from 0."""
    numbers = cores.core_numbers(edges).withColumn("low", -F.col("core"))
    sorted_parts = numbers.repartitionByRange(partitions(edges.sparkSession), "low", "id").sortWithinPartitions("low", "id")
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    pairs = cut(sorted_parts.select("id", "core", F.spark_partition_id().alias("part"), at.alias("at")))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    starts = pairs.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return pairs.join(starts, "part").select("id", "core", (F.col("start") + F.col("at")).alias("place"))


def smallest_vertex(edges: DataFrame) -> DataFrame:
    return graph.vertices_of(edges).agg(F.min("id").alias("id"))


def ego_edges(edges: DataFrame) -> DataFrame:
    """The closed ego network of the smallest vertex, induced."""
    edges = cut(edges)
    return graph.induced(edges, graph.closed_neighbourhood(edges, smallest_vertex(edges)))


def two_step_ball(edges: DataFrame) -> DataFrame:
    edges = cut(edges)
    return graph.ball(edges, smallest_vertex(edges), 2)


def top_degree_induced(edges: DataFrame) -> DataFrame:
    """The subgraph of vertices whose degree is at least the mean."""
    deg = cut(graph.degrees(edges))
    mean = deg.agg(F.avg("degree").alias("mean"))
    return graph.induced(edges, deg.join(mean, F.col("degree") >= F.col("mean")))


def touching_low(edges: DataFrame) -> DataFrame:
    """Triangles with a member among the vertices whose id is divisible by 10."""
    edges = stored(edges)
    return as_columns(cliques.cliques_through(edges, graph.vertices_of(edges).filter("id % 10 = 0"), 3), 3)


def inside_even(edges: DataFrame) -> DataFrame:
    return as_columns(cliques.inside(cliques.list_cliques(edges, 3), graph.vertices_of(edges).filter("id % 2 = 0")), 3)


def containing_smallest(edges: DataFrame) -> DataFrame:
    edges = stored(edges)
    return as_columns(cliques.cliques_through(edges, smallest_vertex(edges), 3), 3)


def pattern_ball(edges: DataFrame) -> DataFrame:
    """What lies within a 4-cycle's diameter of the smallest vertex."""
    edges = cut(edges)
    return graph.ball(edges, smallest_vertex(edges), patterns.PATTERNS["4-cycle"].diameter())


def set_neighbourhood(edges: DataFrame) -> DataFrame:
    """Vertices whose id is divisible by 10, and all their neighbours."""
    return graph.closed_neighbourhood(edges, graph.vertices_of(edges).filter("id % 10 = 0"))


def degree_drop(edges: DataFrame) -> DataFrame:
    """How much triangle degree leaves with the smallest vertex."""
    triangles = cut(cliques.list_cliques(edges, 3).withColumn("mult", F.lit(1).cast("bigint")))
    smallest = smallest_vertex(edges).first()[0]
    return patterns.degrees_at(triangles, smallest)


def tailed_at_smallest(edges: DataFrame) -> DataFrame:
    """How many tailed triangles the smallest vertex is in, from those around it alone."""
    edges = cut(edges)
    found = patterns.instances_at(edges, patterns.PATTERNS["tailed-triangle"], smallest_vertex(edges).first()[0])
    return found.agg(F.coalesce(F.sum("mult"), F.lit(0)).cast("bigint").alias("n_instances"))


def clique_cores(edges: DataFrame, k: int) -> DataFrame:
    return cores.instance_core_numbers(cliques.incidence(cliques.identified(cliques.list_cliques(edges, k))))


def batch_cores(edges: DataFrame) -> DataFrame:
    return peel.batch_peel(cliques.incidence(cliques.identified(cliques.list_cliques(edges, 3))))


def levels(edges: DataFrame, k: int) -> DataFrame:
    inc = cliques.incidence(cliques.identified(cliques.list_cliques(edges, k)))
    return peel.level_table(inc, cores.instance_core_numbers(inc))


def best_core(edges: DataFrame, k: int) -> DataFrame:
    return approx.peel_by_level(cliques.identified(cliques.list_cliques(edges, k)))


def top_core(edges: DataFrame, k: int) -> DataFrame:
    return approx.max_core(cliques.identified(cliques.list_cliques(edges, k)))[1]


def densest_core_edges(edges: DataFrame) -> DataFrame:
    """Edges in a triangle of the core that holds every triangle-densest set."""
    edges = cut(edges)
    kept, _, _ = prune.densest_core(cliques.identified(cliques.list_cliques(edges, 3)))
    return prune.covered_edges(edges, kept)


def triangle_components(edges: DataFrame) -> DataFrame:
    """Components of the vertices that triangles join."""
    return prune.instance_components(cliques.identified(cliques.list_cliques(edges, 3)))


def all_components(edges: DataFrame) -> DataFrame:
    return components.connected_components(edges)


def component_table(edges: DataFrame) -> DataFrame:
    found = find_instances(edges, 2)
    return prune.component_densities(found, cut(prune.instance_components(found)))


def bound_table(edges: DataFrame, k: int = 3) -> DataFrame:
    found = find_instances(edges, k)
    table = bounds.density_bounds(found, cut(prune.instance_components(found)), cores.instance_core_numbers(cliques.incidence(found)), k)
    exact = ("component", "n_vertices", "n_instances", "k_max")
    return table.select(*exact, *[F.round(c, 6).alias(c) for c in table.columns if c not in exact])


def fixed(edges: DataFrame, k: int) -> DataFrame:
    return cores.fixed_core(cliques.incidence(cliques.identified(cliques.list_cliques(edges, 2))), k)


def densest_members(pattern: int | str, **options) -> Callable[[DataFrame], DataFrame]:
    """(id, numer, denom, exact, gap): the members; ``gap`` is null where no bound on other sets was asked for."""

    def run(edges: DataFrame) -> DataFrame:
        ship(edges.sparkSession)
        best = densest_subgraph(edges if isinstance(pattern, int) else cut(edges), pattern, **options)  # cliques write out what they read twice
        numer, denom = (F.lit(n).cast("bigint") for n in (best.numer, best.denom))
        return best.members.select("id", numer.alias("numer"), denom.alias("denom"), F.lit(best.exact).alias("exact"), F.lit(best.gap).cast("double").alias("gap"))

    return run


def pattern_count(name: str) -> Callable[[DataFrame], DataFrame]:
    return lambda edges: patterns.instances(edges, patterns.PATTERNS[name]).agg(F.coalesce(F.sum("mult"), F.lit(0)).cast("bigint").alias("n_instances"))


def pattern_peel(name: str) -> Callable[[DataFrame], DataFrame]:
    return lambda edges: approx.peel_by_level(find_instances(edges, name))


def trace(edges: DataFrame) -> DataFrame:
    return peel.peel_trace(find_instances(edges, 3))


def peel_app(edges: DataFrame) -> DataFrame:
    return approx.peel_by_vertex(find_instances(edges, 3))


def binomials(edges: DataFrame) -> DataFrame:
    deg = graph.degrees(edges)
    return deg.select("id", binomial(F.col("degree"), 2).alias("pairs"), binomial(F.col("degree"), 3).alias("triples"))


QUERIES: dict[str, Query] = {
    # sources
    "graph_click_edges": click,
    "graph_follow_edges": follow,
    "graph_parts_edges": parts,
    "graph_part2x_edges": part2x,
    "source_vertex_ids": on(parts, graph.vertices_of),
    "source_dense_ids": on(part2x, lambda e: graph.dense_ids(graph.vertices_of(e))),
    "source_dense_edges": on(part2x, dense_edges),
    "source_adjacency_lines": on(click, adjacency_text),
    "file_adjacency_edges": on(click, lambda e: adjacency_file(e)[0]),
    "file_adjacency_vertices": on(click, lambda e: adjacency_file(e)[1]),
    "file_adjacency_edges_parts": on(parts, lambda e: adjacency_file(e)[0]),
    "file_adjacency_vertices_parts": on(parts, lambda e: adjacency_file(e)[1]),
    "file_edge_list": on(part2x, edge_list_file),
    "file_matrix_edges": nation_matrix_file,
    "file_pattern_count": on(click, file_pattern_count),
    # preparation
    "graph_counts": on(parts, graph.graph_counts),
    "degrees": on(parts, graph.degrees),
    "codegrees": on(parts, patterns.codegrees),
    "binomials": on(click, binomials),
    "oriented_edges": on(click, graph.orient),
    "induced_edges": on(click, top_degree_induced),
    "ego_edges": on(click, ego_edges),
    "two_step_ball": on(parts, two_step_ball),
    "set_neighbourhood": on(click, set_neighbourhood),
    "pattern_ball": on(part2x, pattern_ball),
    "core_numbers": on(click, cores.core_numbers),
    "core_order": on(click, placed_by_core),
    "core_histogram": on(click, lambda e: cores.core_histogram(cores.core_numbers(e))),
    "fixed_core_16": on(click, lambda e: cores.fixed_core(cliques.incidence(cliques.identified(cliques.list_cliques(e, 2))), 16)),
    "edge_levels": on(click, lambda e: cliques.edge_levels(e, cores.core_numbers(e))),
    # cliques
    "triangles": on(parts, lambda e: as_columns(cliques.list_cliques(e, 3), 3)),
    "four_cliques": on(click, lambda e: as_columns(cliques.list_cliques(e, 4), 4)),
    "five_clique_count_parts": on(parts, lambda e: cliques.count_cliques(e, 5)),
    "five_clique_count_follow": on(follow, lambda e: cliques.count_cliques(e, 5)),
    "five_clique_count": on(click, lambda e: cliques.count_cliques(e, 5)),
    "triangle_count": on(parts, lambda e: cliques.count_cliques(e, 3)),
    "follow_triangle_count": on(follow, lambda e: cliques.count_cliques(e, 3)),
    "follow_core_numbers": on(follow, cores.core_numbers),
    "four_clique_count": on(click, lambda e: cliques.count_cliques(e, 4)),
    "triangle_degrees": on(parts, lambda e: cliques.clique_degrees(e, 3)),
    "four_clique_degrees": on(click, lambda e: cliques.clique_degrees(e, 4)),
    "triangles_touching": on(click, touching_low),
    "triangles_touching_parts": on(parts, touching_low),
    "triangles_containing_parts": on(parts, containing_smallest),
    "triangles_inside": on(click, inside_even),
    "triangles_containing": on(click, containing_smallest),
    "covered_edges": on(parts, prune.edges_in_triangles),
    "triangle_degree_drop": on(click, degree_drop),
    # patterns
    "pattern_tailed_triangle": on(click, patterns.tailed_triangle_count),
    "pattern_tailed_triangle_degrees": on(click, patterns.tailed_triangle_degrees),
    "pattern_basket_degrees": on(click, patterns.basket_degrees),
    "pattern_three_triangle_degrees": on(click, lambda e: patterns.common_edge_triangles_degrees(e, 3)),
    "pattern_tailed_triangle_at_smallest": on(click, tailed_at_smallest),
    "pattern_two_triangle": on(click, lambda e: patterns.common_edge_triangles_count(e, 2)),
    "pattern_three_triangle": on(click, lambda e: patterns.common_edge_triangles_count(e, 3)),
    "pattern_two_triangle_degrees": on(click, lambda e: patterns.common_edge_triangles_degrees(e, 2)),
    "pattern_basket": on(click, patterns.basket_count),
    "pattern_star3_degrees": on(parts, lambda e: patterns.star_degrees(e, 3)),
    "pattern_star3": on(parts, lambda e: patterns.star_count(e, 3)),
    "pattern_four_cycle": on(click, patterns.four_cycle_count),
    "pattern_four_cycle_degrees": on(click, patterns.four_cycle_degrees),
    "pattern_generic_tailed_triangle": on(part2x, pattern_count("tailed-triangle")),
    "pattern_generic_four_cycle": on(part2x, pattern_count("4-cycle")),
    "pattern_generic_tailed_triangle_parts": on(parts, lambda e: patterns.count_matches(e, patterns.PATTERNS["tailed-triangle"])),
    "pattern_generic_two_triangle_sets": on(part2x, lambda e: as_columns(patterns.instances(e, patterns.PATTERNS["2-triangle"]), 4)),
    "pattern_four_cycle_core": on(part2x, closed_cores.four_cycle_cores),
    "pattern_four_cycle_core_click": on(click, closed_cores.four_cycle_cores),
    "pattern_star2_core": on(part2x, lambda e: closed_cores.star_cores(e, 2)),
    "pattern_four_cycle_peel": on(part2x, pattern_peel("4-cycle")),
    "pattern_star2_peel": on(part2x, pattern_peel("2-star")),
    # cores and peeling
    "triangle_core_numbers": on(click, lambda e: clique_cores(e, 3)),
    "triangle_core_batch": on(click, batch_cores),
    "edge_level_table": on(click, lambda e: levels(e, 2)),
    "triangle_level_table": on(click, lambda e: levels(e, 3)),
    "peel_best_core_edges": on(click, lambda e: best_core(e, 2)),
    "peel_best_core_triangles": on(click, lambda e: best_core(e, 3)),
    "max_core_triangles": on(click, lambda e: top_core(e, 3)),
    "max_core_top_down": on(click, lambda e: approx.max_core_top_down(e, 3)),
    "core_estimates": on(click, lambda e: approx.core_estimates(e, 3)),
    "peel_trace": on(click, trace),
    "peel_best_state": on(click, peel_app),
    # pruning, components, bounds
    "densest_core_edges": on(click, densest_core_edges),
    "components": on(part2x, all_components),
    "triangle_components": on(part2x, triangle_components),
    "component_densities": on(part2x, component_table),
    "bounds": on(click, bound_table),
    # the query
    "densest_edges": on(part2x, densest_members(2)),
    "densest_triangles": on(click, densest_members(3)),
    "densest_triangles_unpruned": on(part2x, densest_members(3, prune=False)),
    "densest_triangles_part2x": on(part2x, densest_members(3)),
    "densest_two_triangles": on(part2x, densest_members("2-triangle")),
    "densest_four_cycles": on(part2x, densest_members("4-cycle")),
    "densest_triangles_early_stop": on(click, densest_members(3, most_cuts=1)),
    "densest_triangles_balanced": on(click, densest_members(3, most_instances=0)),
    "densest_triangles_within_gap": on(click, densest_members(3, most_instances=0, tolerance=0.01)),
    "densest_triangles_follow": on(follow, densest_members(3)),
    "densest_edges_parts": on(parts, densest_members(2)),
    "densest_triangles_parts": on(parts, densest_members(3)),
    "densest_triangles_peel": on(click, densest_members(3, method="peel")),
    "densest_triangles_max_core": on(click, densest_members(3, method="max_core")),
    "densest_report": on(click, report),
    "share_loads": on(part2x, lambda e: approx.share_loads(find_instances(e, 2))),
}
