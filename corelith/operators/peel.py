"""Clique-core peeling: level tables, the batch peel, and the removal trace of small cores."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corelith.plans.session import cut, ship

TRACE = "step bigint, id bigint, residual_degree bigint, core bigint, remaining_vertices bigint, remaining_instances bigint"


def instance_levels(incidence: DataFrame, cores: DataFrame) -> DataFrame:
    """(clique_id, mult, level): the level at which an instance leaves, its members' smallest core number."""
    return incidence.join(cores, "id").groupBy("clique_id").agg(F.first("mult").alias("mult"), F.min("core").alias("level"))


def level_table(incidence: DataFrame, cores: DataFrame) -> DataFrame:
    """(level, n_vertices, n_instances): size of the (level, pattern)-core for each core number that occurs.

    One row for each distinct core number, so the running sums are over a small frame.
    """
    at_level = cores.groupBy(F.col("core").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    left_at = instance_levels(incidence, cores).groupBy("level").agg(F.sum("mult").alias("t"))
    from_here = Window.orderBy(F.col("level").desc())
    return (
        at_level.join(left_at, "level", "left")
        .select(
            "level",
            F.sum("n").over(from_here).alias("n_vertices"),
            F.coalesce(F.sum("t").over(from_here), F.lit(0).cast("bigint")).alias("n_instances"),
        )
    )


def best_level(levels: DataFrame) -> DataFrame:
    """One row: the densest level; of equal densities the lowest, which has the largest set."""
    ranked = F.row_number().over(Window.orderBy((F.col("n_instances") / F.col("n_vertices")).desc(), "level"))
    return levels.withColumn("place", ranked).filter("place = 1").select("level", "n_vertices", "n_instances")


def batch_peel(incidence: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(id, core) by removing, level by level, all vertices whose residual degree is at most the level.

    The synchronous form of sequential peeling. It takes more rounds than the fixed point in ``cores`` and serves to check
    it, and where levels have to be seen one after another.
    """
    alive, out, level = cut(incidence), None, 0
    for _ in range(max_rounds):
        residual = cut(alive.groupBy("id").agg(F.sum("mult").alias("n")))
        low = residual.agg(F.min("n")).first()[0]
        if low is None:
            break
        level = max(level, low)
        gone = cut(residual.filter(F.col("n") <= level).select("id", F.lit(level).cast("bigint").alias("core")))
        out = gone if out is None else out.unionByName(gone)
        dead = alive.join(gone, "id", "left_semi").select("clique_id").distinct()
        rest = cut(alive.join(dead, "clique_id", "left_anti"))
        # Vertices that lose all their instances at once leave at this level, too.
        orphans = residual.join(gone, "id", "left_anti").join(rest.select("id").distinct(), "id", "left_anti")
        out = out.unionByName(orphans.select("id", F.lit(level).cast("bigint").alias("core")))
        alive = rest
    else:
        raise RuntimeError(f"peeling did not end in {max_rounds} rounds")
    if out is None:
        return incidence.select("id", F.lit(0).cast("bigint").alias("core")).limit(0)
    return out


def peel_sequence(members: list[list[int]], mults: list[int], vertices: list[int]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows of ``TRACE``: always the vertex of smallest (residual degree, id) goes."""
    at: dict[int, list[int]] = {v: [] for v in vertices}
    for i, group in enumerate(members):
        for v in group:
            at.setdefault(v, []).append(i)
    degree = {v: sum(mults[i] for i in own) for v, own in at.items()}
    alive, left, total = [True] * len(members), len(at), sum(mults)
    heap = [(d, v) for v, d in degree.items()]
    heapq.heapify(heap)
    gone, core, rows = set(), 0, []
    while heap:
        d, v = heapq.heappop(heap)
        if v in gone or d != degree[v]:
            continue
        gone.add(v)
        core, left = max(core, d), left - 1
        for i in at[v]:
            if alive[i]:
                alive[i] = False
                total -= mults[i]
                for w in members[i]:
                    if w not in gone:
                        degree[w] -= mults[i]
                        heapq.heappush(heap, (degree[w], w))
        rows.append((len(rows) + 1, v, d, core, left, total))
    return rows


def peel_trace(instances: DataFrame, vertices: DataFrame | None = None, most_instances: int = 2_000_000) -> DataFrame:
    """The exact removal order in one task; refuses more than ``most_instances`` instances (see ``level_table``).

    Prune to a core before asking for a trace: the order is sequential by nature.
    """
    ship(instances.sparkSession)
    if (n := instances.count()) > most_instances:
        raise ValueError(f"a trace of {n} instances is not one task's work; use level_table")
    isolated = F.lit(None).cast("array<bigint>")
    rows = instances.select("members", "mult", F.lit(None).cast("bigint").alias("vertex"))
    if vertices is not None:
        rows = rows.unionByName(vertices.select(isolated.alias("members"), F.lit(0).cast("bigint").alias("mult"), F.col("id").alias("vertex")))

    def trace(group: pd.DataFrame) -> pd.DataFrame:
        real = group[group["members"].notna()]
        made = peel_sequence([list(map(int, m)) for m in real["members"]], real["mult"].astype(int).tolist(), group["vertex"].dropna().astype(int).tolist())
        return pd.DataFrame(made, columns=[c.split()[0] for c in TRACE.split(", ")])

    return rows.withColumn("whole", F.lit(0)).groupBy("whole").applyInPandas(trace, TRACE)
