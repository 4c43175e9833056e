"""Approximate densest sets: peeling, the maximum core, and top-down search for the maximum core."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corelith.functions import binomial
from corelith.operators.cliques import identified, incidence, list_cliques
from corelith.operators.cores import core_numbers, instance_core_numbers
from corelith.operators.graph import induced, side_by_side
from corelith.operators.peel import best_level, instance_levels, level_table, peel_trace
from corelith.operators.prune import within
from corelith.plans.session import cut


def peel_by_level(instances: DataFrame) -> DataFrame:
    """One row (level, n_vertices, n_instances): the densest core, at least 1 / k of the best density."""
    inc = incidence(instances)
    return best_level(level_table(inc, instance_core_numbers(inc)))


def peel_by_vertex(instances: DataFrame, most_instances: int = 2_000_000) -> DataFrame:
    """One row (n_vertices, n_instances): the densest state along the removal of single vertices, the whole graph included."""
    whole = side_by_side(
        incidence(instances).agg(F.countDistinct("id").alias("n_vertices")),
        instances.agg(F.coalesce(F.sum("mult"), F.lit(0)).cast("bigint").alias("n_instances")),
    )
    trace = peel_trace(instances, most_instances=most_instances)
    states = trace.filter("remaining_vertices > 0").select(F.col("remaining_vertices").alias("n_vertices"), F.col("remaining_instances").alias("n_instances"))
    return (
        states.unionByName(whole.filter("n_vertices > 0"))
        .orderBy((F.col("n_instances") / F.col("n_vertices")).desc(), F.col("n_vertices").desc())
        .limit(1)
    )


def max_core(instances: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The vertices (id) of the core of highest number, and one row (k_max, n_vertices, n_instances)."""
    inc = incidence(instances)
    cores = cut(instance_core_numbers(inc))
    top = cores.agg(F.max("core").alias("k_max"))
    ids = cores.join(top, F.col("core") == F.col("k_max")).select("id", "k_max")
    held = instance_levels(inc, cores).join(top, F.col("level") == F.col("k_max")).agg(F.coalesce(F.sum("mult"), F.lit(0)).cast("bigint").alias("n_instances"))
    stats = side_by_side(ids.agg(F.max("k_max").alias("k_max"), F.count(F.lit(1)).alias("n_vertices")), held)
    return ids.select("id"), stats.filter("k_max is not null")


def core_estimates(edges: DataFrame, k: int) -> DataFrame:
    """(id, bound): C(core, k - 1), which no clique core number exceeds."""
    return core_numbers(edges).select("id", binomial(F.col("core"), k - 1).alias("bound"))


def max_core_top_down(edges: DataFrame, k: int, first: int = 64) -> DataFrame:
    """(id, core): vertices of the maximum k-clique core, found among the vertices of highest bounds.

    The prefix of vertices doubles until no vertex outside has a bound above the maximum core inside. Prefixes are cut
    by bound, so vertices of equal bounds come in together.
    """
    bounds = cut(core_estimates(edges, k))
    down = Window.orderBy(F.col("bound").desc())
    counted = cut(bounds.groupBy("bound").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", F.sum("n").over(down)))  # a row for each bound
    n, size = bounds.count(), first
    while True:
        floor = counted.agg(F.coalesce(F.max(F.when(F.col("upto") >= size, F.col("bound"))), F.min("bound"))).first()[0]
        if floor is None:
            return bounds.select("id", F.col("bound").alias("core")).limit(0)
        inner = bounds.filter(F.col("bound") >= floor)
        found = identified(list_cliques(induced(edges, inner), k))
        cores = cut(instance_core_numbers(incidence(found)))
        best = cores.agg(F.coalesce(F.max("core"), F.lit(0))).first()[0]
        outside = bounds.filter(F.col("bound") < floor).agg(F.max("bound")).first()[0]
        if outside is None or best >= outside and best > 0:
            return cores.filter(F.col("core") == best) if best else cores.limit(0)
        size = min(2 * max(size, inner.count()), n)


def share_loads(instances: DataFrame, rounds: int = 8) -> DataFrame:
    """(id, load): every instance gives its units to its least loaded member, round after round.

    The largest load over ``rounds`` comes down towards the best density, which it never falls below.
    """
    inc = cut(incidence(instances))
    loads = cut(inc.select("id").distinct().withColumn("load", F.lit(0).cast("bigint")))
    for _ in range(rounds):
        taken = inc.join(loads, "id").groupBy("clique_id").agg(F.min(F.struct("load", "id")).alias("low"), F.first("mult").alias("mult"))
        given = taken.groupBy(F.col("low.id").alias("id")).agg(F.sum("mult").alias("more"))
        loads = cut(loads.join(given, "id", "left").select("id", (F.col("load") + F.coalesce("more", F.lit(0))).alias("load")))
    return loads


def members_within(instances: DataFrame, ids: DataFrame) -> DataFrame:
    """One row (n_vertices, n_instances): the density of any vertex set, as two whole numbers."""
    held = within(instances, ids).agg(F.coalesce(F.sum("mult"), F.lit(0)).cast("bigint").alias("n_instances"))
    return side_by_side(ids.select("id").distinct().agg(F.count(F.lit(1)).alias("n_vertices")), held)
