"""Core numbers as the fixed point of an H-index iteration, for edges, cliques and other instances.

An instance is worth the smallest value of its members; a vertex's next value is the H-index of its instances'
worths. From instance degrees down, the iteration settles at the core numbers whatever the order.

A value changes only if fewer instances than the value are still worth as much. So while many vertices are left, a round first
counts these (a partition sends one row a vertex at most), and only vertices that fall short gather
their instances' worths: what is shuffled shrinks as values settle. A hub's instances are counted by worth before they meet, and there are
at most as many worths as its value, so no vertex gathers its instances in one task. Where few vertices are left, their
values are broadcast to the instances, which are then not shuffled at all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corelith.functions import h_value
from corelith.operators.graph import degrees
from corelith.plans.session import cut

#: Up to this many vertices, values are broadcast.
FEW_VERTICES = 500_000
#: Rounds between looks at the sum of values.
LOOK = 2


def _h_step(worths: DataFrame) -> DataFrame:
    """(id, h) from (id, worth, n)."""
    counted = worths.groupBy("id", "worth").agg(F.sum("n").alias("n"))
    down = Window.partitionBy("id").orderBy(F.col("worth").desc())
    return counted.withColumn("upto", F.sum("n").over(down)).groupBy("id").agg(h_value(F.col("worth"), F.col("upto")).alias("h"))


def _settle(start: DataFrame, step: Callable, max_rounds: int) -> DataFrame:
    """Repeats steps until the sum of values stays; values never grow, so an equal sum means equal values."""
    now, total = cut(start), None
    for _ in range(max_rounds):
        found = now.agg(F.coalesce(F.sum("h"), F.lit(0))).first()[0]
        if found == total:
            return now
        total = found
        for _ in range(LOOK):
            now = cut(step(now))
    raise RuntimeError(f"core numbers did not settle in {max_rounds} rounds")


def _fixed_point(rows: DataFrame, ids: list[str], mult: Column, start: DataFrame, max_rounds: int) -> DataFrame:
    """(id, h) for instances that have their members in the columns ``ids``; ``start`` (id, h) are degrees."""
    start = cut(start)
    few = start.count() <= FEW_VERTICES
    send = F.broadcast if few else lambda frame: frame

    def valued(h: DataFrame) -> DataFrame:
        out = rows
        for i in ids:
            out = out.join(send(h.select(F.col("id").alias(i), F.col("h").alias(f"h_{i}"))), i)
        values = [F.col(f"h_{i}") for i in ids]
        return out.withColumn("worth", F.least(*values) if len(values) > 1 else values[0]).withColumn("n", mult)

    def everyone(h: DataFrame) -> DataFrame:
        return _h_step(valued(h).select(F.explode(F.array(*ids)).alias("id"), "worth", "n"))

    def those_that_fall(h: DataFrame) -> DataFrame:
        known = cut(valued(h))
        member = F.explode(F.array(*[F.struct(F.col(i).alias("id"), F.col(f"h_{i}").alias("h")) for i in ids])).alias("m")
        holding = known.select(member, "worth", "n").filter(F.col("worth") >= F.col("m.h")).groupBy(F.col("m.id").alias("id")).agg(F.sum("n").alias("held"))
        falling = cut(h.join(holding, "id", "left").filter(F.coalesce("held", F.lit(0)) < F.col("h")).select("id"))
        worths = known.select(F.explode(F.array(*ids)).alias("id"), "worth", "n").join(falling, "id", "left_semi")
        fresh = _h_step(worths).withColumnRenamed("h", "fresh")
        return h.join(fresh, "id", "left").select("id", F.coalesce("fresh", "h").alias("h"))

    return _settle(start, everyone if few else those_that_fall, max_rounds)


def core_numbers(edges: DataFrame, vertices: DataFrame | None = None, max_rounds: int = 500) -> DataFrame:
    """(id, core) of the k-core decomposition; isolated vertices of ``vertices`` have core 0."""
    edges = cut(edges)
    start = degrees(edges).select("id", F.col("degree").alias("h"))
    return _with_isolated(_fixed_point(edges, ["src", "dst"], F.lit(1).cast("bigint"), start, max_rounds), vertices)


def instance_core_numbers(incidence: DataFrame, vertices: DataFrame | None = None, max_rounds: int = 500) -> DataFrame:
    """(id, core) of the core decomposition by instances (id, clique_id, mult), all of one size or not."""
    start = incidence.groupBy("id").agg(F.sum("mult").alias("h"))
    wide = cut(incidence.groupBy("clique_id").agg(F.collect_list("id").alias("members"), F.first("mult").alias("mult")))
    sizes = wide.agg(F.min(F.size("members")), F.max(F.size("members"))).first()
    if sizes[0] == sizes[1]:
        ids = [f"v{j}" for j in range(sizes[0] or 1)]
        rows = wide.select(*[F.get("members", F.lit(j)).alias(i) for j, i in enumerate(ids)], "mult")
        return _with_isolated(_fixed_point(rows, ids, F.col("mult"), start, max_rounds), vertices)
    incidence = cut(incidence)

    def step(h: DataFrame) -> DataFrame:
        worth = incidence.join(h, "id").groupBy("clique_id").agg(F.min("h").alias("worth"))
        return _h_step(incidence.join(worth, "clique_id").select("id", "worth", F.col("mult").alias("n")))

    return _with_isolated(_settle(start, step, max_rounds), vertices)


def _with_isolated(settled: DataFrame, vertices: DataFrame | None) -> DataFrame:
    if vertices is None:
        return settled.select("id", F.col("h").alias("core"))
    return vertices.select("id").distinct().join(settled, "id", "left").select("id", F.coalesce("h", F.lit(0).cast("bigint")).alias("core"))


def core_histogram(cores: DataFrame, width: int = 5) -> DataFrame:
    """(bucket, n_vertices): core numbers in steps of ``width``; empty buckets have no row."""
    return cores.groupBy(F.floor(F.col("core") / width).cast("bigint").alias("bucket")).agg(F.count(F.lit(1)).alias("n_vertices"))


def fixed_core(incidence: DataFrame, k: int, max_rounds: int = 500) -> DataFrame:
    """(id): the k-core by instances, found by removing vertices in fewer than k instances until none is left."""
    alive, before = cut(incidence), None
    for _ in range(max_rounds):
        now = alive.count()
        if now == before:
            return alive.select("id").distinct() if k > 0 else incidence.select("id").distinct()
        before = now
        weak = alive.groupBy("id").agg(F.sum("mult").alias("n")).filter(F.col("n") < k).select("id")
        dead = alive.join(weak, "id", "left_semi").select("clique_id").distinct()
        alive = cut(alive.join(dead, "clique_id", "left_anti"))
    raise RuntimeError(f"the {k}-core did not settle in {max_rounds} rounds")
