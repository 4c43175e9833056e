"""Bounds on the best density, as a frame for each component."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corelith.functions import clique_upper_bound
from corelith.operators.cliques import incidence
from corelith.operators.prune import with_component


def density_bounds(instances: DataFrame, components: DataFrame, cores: DataFrame, k: int) -> DataFrame:
    """(component, n_vertices, n_instances, k_max, lower_density, lower_core, upper_core, upper_cliques, spread, upper_choose, gap).

    ``upper_cliques`` holds for cliques only. ``spread`` is t * sum((d / (k t))^2): a statistic of how evenly instances are
    spread. It is no bound, and nothing is pruned by it. ``gap`` is the least distance of two densities.
    """
    held = with_component(instances, components)
    degree = incidence(held).groupBy("id").agg(F.sum("mult").alias("d")).join(components, "id")
    squares = degree.groupBy("component").agg(F.sum(F.col("d").cast("double") * F.col("d")).alias("squares"))
    size = components.join(cores, "id").groupBy("component").agg(F.count(F.lit(1)).alias("n_vertices"), F.max("core").alias("k_max"))
    total = held.groupBy("component").agg(F.sum("mult").alias("n_instances"))
    n, t = F.col("n_vertices"), F.col("n_instances").cast("double")
    choose = F.lit(1.0)
    for i in range(k):
        choose = choose * (n - i) / (i + 1)
    return (
        size.join(total, "component")
        .join(squares, "component")
        .select(
            "component",
            "n_vertices",
            "n_instances",
            "k_max",
            (t / n).alias("lower_density"),
            (F.col("k_max") / k).alias("lower_core"),
            F.col("k_max").cast("double").alias("upper_core"),
            clique_upper_bound(t, k).alias("upper_cliques"),
            (F.col("squares") / (k * k * t)).alias("spread"),
            (choose / n).alias("upper_choose"),
            (1 / (n * F.greatest(n - 1, F.lit(1)))).alias("gap"),
        )
    )


def clique_bound_of_core(core: int, k: int) -> int:
    """C(core, k - 1): how many k-cliques a vertex of this edge core can be in while it is peeled."""
    return math.comb(core, k - 1)
