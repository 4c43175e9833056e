"""k-clique enumeration by level-wise frontiers over an oriented graph.

A frontier row holds the members found so far and the candidates that are out-neighbours of all of them. Rows that
cannot reach k members any more are dropped at once, and counting never builds the last level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corelith.operators.graph import closed_neighbourhood, degrees, induced, orient
from corelith.operators.wedges import closing
from corelith.plans.session import cut, stored

#: Facts of up to as many vertices are broadcast, so that edges are not shuffled for them.
FEW_VERTICES = 500_000


def _out_lists(dag: DataFrame) -> DataFrame:
    return dag.groupBy("u").agg(F.sort_array(F.collect_list("v")).alias("out"))


def _closed_edges(edges: DataFrame, least: int = 1) -> DataFrame:
    """(u, v, cand): each edge, oriented, with the out-neighbours that its ends share, where there are ``least`` or more.

    ``edges`` is read twice and best written out already.
    """
    return closing(orient(edges), *_size(edges), least)


def _size(edges: DataFrame) -> tuple[int, bool]:
    """The number of edges, and whether all ids fit into 32 bits."""
    facts = edges.agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("low"), F.max("dst").alias("high")).first()
    return facts["n"], facts["n"] > 0 and facts["low"] >= -(1 << 31) and facts["high"] < 1 << 31


def _frontier(edges: DataFrame, k: int, dag: DataFrame | None = None) -> DataFrame:
    """(members, cand) with k - 1 members each, for k >= 3; where ``dag`` has a column ``root``, only those whose first member is one."""
    if dag is None:
        edges = stored(edges)
        now = _closed_edges(edges, k - 2).select(F.array("u", "v").alias("members"), "cand")
        if k == 3:
            return now
        dag = orient(edges)
        out = _out_lists(dag)
    elif "root" in dag.columns:
        dag = dag if k == 3 else stored(dag)
        now = closing(dag, *_size(edges), k - 2).select(F.array("u", "v").alias("members"), "cand")
        out = _out_lists(dag)
    else:
        out = _out_lists(dag)
        now = (
            dag.join(out, "u")
            .withColumnRenamed("out", "out_u")
            .join(out.select(F.col("u").alias("v"), F.col("out").alias("out_v")), "v")
            .select(F.array("u", "v").alias("members"), F.array_intersect("out_u", "out_v").alias("cand"))
            .filter(F.size("cand") >= k - 2)
        )
    for level in range(3, k):
        now = (
            now.select("members", "cand", F.explode("cand").alias("u"))
            .join(out, "u")
            .select(F.array_append("members", F.col("u")).alias("members"), F.array_intersect("cand", "out").alias("cand"))
            .filter(F.size("cand") >= k - level)
        )
    return now


def list_cliques(edges: DataFrame, k: int, dag: DataFrame | None = None) -> DataFrame:
    """(members): ascending member lists of all k-cliques, k >= 1."""
    if k < 1:
        raise ValueError("k must be at least 1")
    if k == 1:
        return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().select(F.array("id").alias("members"))
    if k == 2:
        return edges.select(F.array("src", "dst").alias("members"))
    return _frontier(edges, k, dag).select("members", F.explode("cand").alias("w")).select(F.sort_array(F.array_append("members", F.col("w"))).alias("members"))


def count_cliques(edges: DataFrame, k: int) -> DataFrame:
    """One row: n_cliques."""
    if k <= 2:
        return list_cliques(edges, k).agg(F.count(F.lit(1)).alias("n_cliques"))
    return _frontier(edges, k).agg(F.coalesce(F.sum(F.size("cand")), F.lit(0)).cast("bigint").alias("n_cliques"))


def clique_degrees(edges: DataFrame, k: int, vertices: DataFrame | None = None) -> DataFrame:
    """(id, clique_degree): how many k-cliques hold each vertex, without listing the last level for members before it."""
    if k <= 2:
        counted = list_cliques(edges, k).select(F.explode("members").alias("id"), F.lit(1).cast("bigint").alias("n"))
    else:
        each = lambda ids, n: F.transform(ids, lambda i: F.struct(i.alias("id"), n.cast("bigint").alias("n")))
        both = F.concat(each("members", F.size("cand")), each("cand", F.lit(1)))
        counted = _frontier(edges, k).select(F.explode(both).alias("c")).select("c.*")
    deg = counted.groupBy("id").agg(F.sum("n").alias("clique_degree"))
    if vertices is None:
        return deg
    return vertices.join(deg, "id", "left").select("id", F.coalesce("clique_degree", F.lit(0).cast("bigint")).alias("clique_degree"))


def identified(cliques: DataFrame) -> DataFrame:
    """(clique_id, members, mult), written out so that ids stay the same whenever the rows are read."""
    mult = F.col("mult") if "mult" in cliques.columns else F.lit(1).cast("bigint")
    return cut(cliques.select(F.monotonically_increasing_id().alias("clique_id"), "members", mult.alias("mult")))


def as_columns(cliques: DataFrame, k: int) -> DataFrame:
    """(v0, v1, ..., mult) from (members, mult): narrower when written than lists, and nothing is to be unpacked."""
    return cliques.select(*[F.col("members")[j].alias(f"v{j}") for j in range(k)], "mult")


def as_members(wide: DataFrame) -> DataFrame:
    """(members, mult), members ascending, from columns."""
    return wide.select(F.sort_array(F.array(*[c for c in wide.columns if c != "mult"])).alias("members"), "mult")


def clique_columns(edges: DataFrame, k: int) -> DataFrame:
    """All k-cliques as columns (v0, v1, ..., mult) in any order of members."""
    one = F.lit(1).cast("bigint").alias("mult")
    if k < 3:
        return as_columns(list_cliques(edges, k).withColumn("mult", one), k)
    return _frontier(edges, k).select(*[F.col("members")[j].alias(f"v{j}") for j in range(k - 1)], F.explode("cand").alias(f"v{k - 1}"), one)


def incidence(cliques: DataFrame) -> DataFrame:
    """(id, clique_id, mult) from identified cliques."""
    return cliques.select(F.explode("members").alias("id"), "clique_id", "mult")


def containing(cliques: DataFrame, vertex: int) -> DataFrame:
    return cliques.filter(F.array_contains("members", vertex))


def touching(cliques: DataFrame, ids: DataFrame) -> DataFrame:
    """Cliques with at least one member among ``ids`` (id)."""
    hit = cliques.withColumn("id", F.explode("members")).join(ids.select("id").distinct(), "id", "left_semi")
    return hit.select("members").distinct()


def inside(cliques: DataFrame, ids: DataFrame) -> DataFrame:
    """Cliques whose members are all among ``ids``."""
    kept = ids.select("id").distinct().withColumn("in", F.lit(1))
    counted = (
        cliques.withColumn("id", F.explode("members")).join(kept, "id").groupBy("members").agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in cliques.columns if c != "members"])
    )
    return counted.filter(F.col("n") == F.size("members")).select(*cliques.columns)


def cliques_through(edges: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(members): the k-cliques with at least one member among ``ids`` (id), found from there.

    Edges are oriented away from ``ids``, so the first member of each clique that touches them is one of them, and the frontier
    starts at these alone, within their closed neighbourhood: the cost grows with it and not with the graph. Where that may be much
    of the graph, the graph is not copied. ``edges`` is read several times and best written out already.
    """
    seeds = cut(ids.select(F.col("id").cast("bigint").alias("id")).distinct())
    if k <= 2:
        return touching(list_cliques(edges, k), seeds)
    deg = cut(degrees(edges))
    around = deg.join(seeds, "id").agg(F.coalesce(F.sum("degree"), F.lit(0)) + F.count(F.lit(1))).first()[0]
    if 4 * around < deg.count():
        edges = stored(induced(edges, closed_neighbourhood(edges, seeds)))
        deg = cut(degrees(edges))
    ranks = cut(deg.join(seeds.withColumn("seed", F.lit(0)), "id", "left").select("id", F.coalesce("seed", F.lit(1)).alias("after"), "degree"))
    ranks = F.broadcast(ranks) if ranks.count() <= FEW_VERTICES else ranks
    by = lambda end: ranks.select(F.col("id").alias(end), F.col("after").alias(f"after_{end}"), F.col("degree").alias(f"d_{end}"))
    ends = edges.join(by("src"), "src").join(by("dst"), "dst")
    first = F.struct("after_src", "d_src", "src") < F.struct("after_dst", "d_dst", "dst")
    turned = lambda one, other: F.when(first, F.col(one)).otherwise(F.col(other))
    dag = ends.select(turned("src", "dst").alias("u"), turned("dst", "src").alias("v"), (F.least("after_src", "after_dst") == 0).alias("root"))
    found = _frontier(edges, k, dag)
    return found.select("members", F.explode("cand").alias("w")).select(F.sort_array(F.array_append("members", F.col("w"))).alias("members"))


def member_pairs(cliques: DataFrame) -> DataFrame:
    """(src, dst): the edges that lie in some clique."""
    pairs = F.flatten(
        F.transform("members", lambda a: F.transform(F.filter("members", lambda b: b > a), lambda b: F.struct(a.alias("src"), b.alias("dst"))))
    )
    return cliques.select(F.explode(pairs).alias("p")).select("p.src", "p.dst").distinct()


def codegree_table(edges: DataFrame) -> DataFrame:
    """(src, dst, codegree) of all edges: what closes an edge counts for it, and one for each of the two other sides."""
    side = lambda a, b, n: F.struct(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"), n.cast("bigint").alias("n"))
    u, v = F.col("u"), F.col("v")
    others = F.flatten(F.transform("cand", lambda w: F.array(side(u, w, F.lit(1)), side(v, w, F.lit(1)))))
    sides = _closed_edges(stored(edges), 0).select(F.explode(F.concat(F.array(side(u, v, F.size("cand"))), others)).alias("e")).select("e.*")
    return sides.groupBy("src", "dst").agg(F.sum("n").alias("codegree"))


def edge_levels(edges: DataFrame, cores: DataFrame) -> DataFrame:
    """(src, dst, level): the smaller core number of an edge's ends, at which the edge leaves."""
    by = lambda end: cores.select(F.col("id").alias(end), F.col("core").alias(f"c_{end}"))
    return edges.join(by("src"), "src").join(by("dst"), "dst").select("src", "dst", F.least("c_src", "c_dst").alias("level"))
