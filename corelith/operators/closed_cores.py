"""Core numbers by stars and 4-cycles without their instances.

Every vertex claims a level. How many instances of all members claiming at least a vertex's own level it is in follows in closed form from
the claims around it: for stars from its neighbours' degrees among such claims, for 4-cycles from ranked wedges. So one pass
over edges or wedges judges all vertices at once, each at its own level.

Core numbers come bit by bit from the highest. Vertices of equal higher bits claim the middle of what is left; who has too few
instances falls back to the lower end, until nobody does; who stands has the bit. Vertices with larger higher bits stay in, those with
smaller ones are out, so all groups are decided side by side. Passes number the bits times the rounds in which claims fall.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corelith.functions import binomial
from corelith.operators.cores import core_numbers
from corelith.operators.graph import symmetric
from corelith.operators.patterns import four_cycle_degrees, ranked_wedges, star_degrees
from corelith.plans.session import cut

#: Up to this many vertices, claims are broadcast.
FEW_VERTICES = 500_000


def cores_by_bits(bounds: DataFrame, count_at: Callable[[DataFrame], DataFrame], max_rounds: int = 10_000) -> DataFrame:
    """(id, core) from (id, least, most), bounds of the core numbers, and a function from (id, claim) to (id, held).

    ``held`` is a vertex's number of instances whose members all claim at least its own claim; vertices of none may be missing.
    """
    state = cut(bounds.select("id", "least", "most", F.lit(0).cast("bigint").alias("core")))
    most = state.agg(F.max("most")).first()[0] or 0
    rounds = 0
    for bit in reversed(range(int(most).bit_length())):
        middle = F.col("core") + F.lit(1 << bit)
        claims = state.withColumn("claim", F.when(F.col("most") >= middle, middle).otherwise(F.col("core")))
        # Who is known to hold as much stands without being counted.
        open_claim = (F.col("claim") > F.col("core")) & (F.col("least") < F.col("claim"))
        fallen = claims.filter(open_claim).count()
        while fallen:
            rounds += 1
            if rounds > max_rounds:
                raise RuntimeError(f"cores did not settle in {max_rounds} rounds")
            held = count_at(claims.select("id", "claim"))
            falls = open_claim & (F.coalesce("held", F.lit(0)) < F.col("claim"))
            judged = cut(claims.join(held, "id", "left").select(*claims.columns, falls.alias("falls")))
            claims = judged.select("id", "least", "most", "core", F.when(F.col("falls"), F.col("core")).otherwise(F.col("claim")).alias("claim"))
            fallen = judged.filter("falls").count()
        # A claim that falls bounds its vertex from above.
        lower = F.least("most", middle - 1)
        state = cut(claims.select("id", "least", F.when(F.col("claim") > F.col("core"), F.col("most")).otherwise(lower).alias("most"), F.col("claim").alias("core")))
    return state.select("id", "core")


def _claimed(rows: DataFrame, claims: DataFrame, few: bool, *ids: str) -> DataFrame:
    """Adds each id column's claim as ``c_`` and its name."""
    for i in ids:
        own = claims.select(F.col("id").alias(i), F.col("claim").alias(f"c_{i}"))
        rows = rows.join(F.broadcast(own) if few else own, i)
    return rows


def star_cores(edges: DataFrame, s: int) -> DataFrame:
    """(id, core) by stars of ``s`` leaves, in passes over the edges.

    A vertex of edge core c is among vertices of at least c neighbours each, so it is in at least C(c, s) + c * C(c - 1, s - 1)
    stars there.
    """
    edges = cut(edges)
    adj = cut(symmetric(edges))
    edge_core = F.col("core")
    least = binomial(edge_core, s) + edge_core * binomial(edge_core - 1, s - 1)
    bounds = cut(core_numbers(edges).select("id", least.alias("least")).join(star_degrees(edges, s).withColumnRenamed("pattern_degree", "most"), "id"))
    few = bounds.count() <= FEW_VERTICES

    def count_at(claims: DataFrame) -> DataFrame:
        ends = _claimed(adj, claims, few, "u", "v")
        # Of u's neighbours, how many claim at least as much as v, v among them.
        beside = Window.partitionBy("u").orderBy(F.col("c_v").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        seen = ends.withColumn("beside", F.count(F.lit(1)).over(beside)).filter("c_u >= c_v")
        sums = seen.groupBy(F.col("v").alias("id")).agg(F.sum(binomial(F.col("beside") - 1, s - 1)).alias("as_leaf"), F.count(F.lit(1)).alias("around"))
        return sums.select("id", (F.col("as_leaf") + binomial(F.col("around"), s)).alias("held"))

    return cores_by_bits(bounds, count_at).filter("core > 0")


def four_cycle_cores(edges: DataFrame) -> DataFrame:
    """(id, core) by 4-cycles, in passes over the ranked wedges that share their ends with another."""
    edges = cut(edges)
    wedges = ranked_wedges(edges)
    paired = Window.partitionBy("x", "y")
    wedges = cut(wedges.withColumn("n", F.count(F.lit(1)).over(paired)).filter("n > 1").drop("n"))
    bounds = cut(four_cycle_degrees(edges).select("id", F.lit(0).cast("bigint").alias("least"), F.col("pattern_degree").alias("most")))
    few = bounds.count() <= FEW_VERTICES

    def count_at(claims: DataFrame) -> DataFrame:
        paths = _claimed(wedges, claims, few, "x", "u", "y")
        low = Window.partitionBy("x", "y").orderBy(F.col("c_u").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        paths = paths.withColumn("beside", F.count(F.lit(1)).over(low))
        ends_up = (F.col("c_x") >= F.col("c_u")) & (F.col("c_y") >= F.col("c_u"))
        middles = paths.filter(ends_up).select(F.col("u").alias("id"), (F.col("beside") - 1).alias("held"))
        both = paths.groupBy("x", "y", "c_x", "c_y").agg(
            F.count(F.when(F.col("c_u") >= F.col("c_x"), 1)).alias("at_x"), F.count(F.when(F.col("c_u") >= F.col("c_y"), 1)).alias("at_y")
        )
        tops = both.filter("c_y >= c_x").select(F.col("x").alias("id"), binomial(F.col("at_x"), 2).alias("held"))
        others = both.filter("c_x >= c_y").select(F.col("y").alias("id"), binomial(F.col("at_y"), 2).alias("held"))
        return middles.unionByName(tops).unionByName(others).groupBy("id").agg(F.sum("held").alias("held"))

    return cores_by_bits(bounds, count_at).filter("core > 0")
