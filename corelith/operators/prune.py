"""Pruning: the densest core, edges in no instance, and raising the threshold by component densities."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corelith.operators.cliques import as_columns, as_members, codegree_table, incidence, member_pairs
from corelith.operators.components import connected_components, contracted_components
from corelith.operators.cores import FEW_VERTICES, instance_core_numbers
from corelith.operators.peel import best_level, level_table
from corelith.plans.session import cut, stored


def densest_core(instances: DataFrame) -> tuple[DataFrame, DataFrame, dict]:
    """Instances (clique_id, members, mult) of the core that holds every densest set, the core numbers, and figures.

    With the best density t / s over levels, every vertex of an optimum has a core number of at least ceil(t / s).
    """
    inc = incidence(instances)
    cores = cut(instance_core_numbers(inc))
    best = best_level(level_table(inc, cores)).first()
    if best is None:
        return instances, cores, {"numer": 0, "denom": 0, "threshold": 0, "k_max": 0}
    threshold = -(-best["n_instances"] // best["n_vertices"])
    kept = within(instances, cores.filter(F.col("core") >= threshold))
    k_max = cores.agg(F.max("core")).first()[0]
    return kept, cores, {"numer": best["n_instances"], "denom": best["n_vertices"], "threshold": threshold, "k_max": k_max}


def dense_part(instances: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Instances (members, mult), all of one size, without vertices in fewer of them than the density of what is left.

    Every member of a densest set is in at least as many of its instances as its density, so the part holds all densest sets. It takes a pass or
    two where core numbers take dozens; what ``max_rounds`` leave is still whole.
    """
    first = instances.select(F.size("members")).first()
    return as_members(dense_columns(as_columns(instances, first[0]), max_rounds)) if first else instances


def dense_columns(wide: DataFrame, max_rounds: int = 50) -> DataFrame:
    """The same for instances as columns (v0, v1, ..., mult), which are best written out already."""
    ids = [c for c in wide.columns if c != "mult"]
    for _ in range(max_rounds):
        counted = cut(wide.select(F.explode(F.array(*ids)).alias("id"), "mult").groupBy("id").agg(F.sum("mult").alias("n")))
        n_vertices, held = counted.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n_vertices:
            break
        weak = counted.filter(F.col("n").cast("decimal(19,0)") * F.lit(n_vertices * len(ids)).cast("decimal(19,0)") < F.lit(held).cast("decimal(38,0)")).select("id")
        number = weak.count()
        if not number:
            break
        weak = F.broadcast(weak) if number <= FEW_VERTICES else weak
        for v in ids:
            wide = wide.join(weak.withColumnRenamed("id", v), v, "left_anti")
        wide = stored(wide.select(*ids, "mult"))
    return wide


def within(instances: DataFrame, ids: DataFrame) -> DataFrame:
    """Identified instances whose members are all among ``ids``."""
    outside = incidence(instances).join(ids.select("id"), "id", "left_anti").select("clique_id").distinct()
    return instances.join(outside, "clique_id", "left_anti")


def covered_edges(edges: DataFrame, cliques: DataFrame) -> DataFrame:
    """Edges that lie in at least one of the cliques."""
    return edges.join(member_pairs(cliques), ["src", "dst"], "left_semi")


def edges_in_triangles(edges: DataFrame) -> DataFrame:
    """The same for all triangles of ``edges``, which are not listed."""
    return codegree_table(edges).filter("codegree > 0").select("src", "dst")


def instance_components(instances: DataFrame) -> DataFrame:
    """(id, component) of the vertices that instances join; component is the smallest id."""
    m = F.col("members")
    chain = instances.select(F.explode(F.slice(m, F.lit(2), F.size(m) - 1)).alias("dst"), m[0].alias("src"))
    return connected_components(chain)


def placed(wide: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Instances as columns (v0, v1, ..., mult) with their ``component``, and its table (component, n_vertices, n_instances, rows).

    Two links of each vertex, to the smallest and the largest it meets, already join nearly all of a dense component. So components are made
    from these alone, and one pass over the instances finds what is still apart.
    """
    ids = [c for c in wide.columns if c != "mult"]
    beside = [F.struct(F.col(a).alias("id"), F.col(b).alias("other")) for a, b in zip(ids, [*ids[1:], ids[0]], strict=True)]
    met = wide.select(F.explode(F.array(*beside)).alias("p")).select("p.*").groupBy("id").agg(F.min("other").alias("low"), F.max("other").alias("high"))
    met = cut(met)
    links = met.select(F.col("id").alias("src"), F.explode(F.array("low", "high")).alias("dst"))
    # A vertex that meets only itself (instances of one member) is a component of its own.
    alone = met.filter((F.col("low") == F.col("id")) & (F.col("high") == F.col("id"))).select("id", F.col("id").alias("component"))
    labels = cut(contracted_components(links).unionByName(alone))
    few = labels.count() <= FEW_VERTICES
    small = F.broadcast if few else (lambda rows: rows)
    wide = wide.join(small(labels.withColumnRenamed("id", ids[0])), ids[0]).select(*ids, "mult", "component")
    if not few:
        wide = stored(wide)
    seen = wide.select(F.explode(F.array(*ids)).alias("id"), F.col("component").alias("src")).distinct()
    apart = cut(seen.join(small(labels), "id").filter("src != component").select("src", F.col("component").alias("dst")).distinct())
    if not apart.isEmpty():
        merged = cut(contracted_components(apart).select(F.col("id").alias("component"), F.col("component").alias("whole")))
        merged = F.broadcast(merged) if merged.count() <= FEW_VERTICES else merged
        wide, labels = (rows.join(merged, "component", "left").withColumn("component", F.coalesce("whole", "component")).drop("whole") for rows in (wide, labels))
    size = labels.groupBy("component").agg(F.count(F.lit(1)).alias("n_vertices"))
    held = wide.groupBy("component").agg(F.sum("mult").alias("n_instances"), F.count(F.lit(1)).alias("rows"))
    return wide, cut(size.join(held, "component"))


def with_component(instances: DataFrame, components: DataFrame) -> DataFrame:
    return instances.withColumn("id", F.col("members")[0]).join(components, "id").drop("id")


def component_densities(instances: DataFrame, components: DataFrame) -> DataFrame:
    """(component, n_vertices, n_instances)."""
    size = components.groupBy("component").agg(F.count(F.lit(1)).alias("n_vertices"))
    held = with_component(instances, components).groupBy("component").agg(F.sum("mult").alias("n_instances"))
    return size.join(held, "component")


def prune_by_components(instances: DataFrame, cores: DataFrame, threshold: int = 0, max_rounds: int = 50) -> tuple[DataFrame, DataFrame, tuple[int, int]]:
    """Repeats: find components, take the densest's density as the new threshold, keep that core.

    ``threshold`` is the core that the instances are of already. Returns the instances left, their components, and the best density as
    (numer, denom).
    """
    for _ in range(max_rounds):
        components = cut(instance_components(instances))
        best = densest_row(component_densities(instances, components), "n_instances", "n_vertices")
        if best is None:
            return instances, components, (0, 0)
        found = -(-best.numerator // best.denominator)
        if found <= threshold:
            return instances, components, (best.numerator, best.denominator)
        threshold = found
        instances = cut(within(instances, cores.filter(F.col("core") >= threshold)))
    raise RuntimeError(f"thresholds did not settle in {max_rounds} rounds")


def densest_row(rows: DataFrame, numer: str = "numer", denom: str = "denom") -> Fraction | None:
    """The highest density numer / denom of any row; doubles propose it, whole numbers decide."""
    rows = cut(rows.select(F.col(numer).cast("decimal(19,0)").alias("a"), F.col(denom).cast("decimal(19,0)").alias("b")).distinct())
    best, left = None, rows
    while True:
        top = left.agg(F.max_by(F.struct("a", "b"), F.col("a").cast("double") / F.col("b").cast("double")).alias("top")).first()["top"]
        if top is None:
            return best
        best = Fraction(int(top["a"]), int(top["b"]))
        left = rows.filter(F.col("a") * best.denominator > F.col("b") * best.numerator)
