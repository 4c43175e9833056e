"""Tumbling windows over a stream of edges, and the batch query over each finished window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corelith.operators.exact import solve_components
from corelith.operators.graph import canonical_edges
from corelith.operators.prune import instance_components
from corelith.plans.densest import find_instances
from corelith.plans.session import cut, ship


def window_edges(stream: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, src, dst) with each window's distinct edges, from (ts, src, dst) rows; works on streams and tables.

    A stream needs the output mode "append": a window's edges come out once it has passed the watermark.
    """
    a, b = F.col("src").cast("bigint"), F.col("dst").cast("bigint")
    pairs = stream.filter(a != b).select("ts", F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"))
    if stream.isStreaming:
        pairs = pairs.withWatermark("ts", late)
    return pairs.groupBy(F.window("ts", length).alias("w"), "src", "dst").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "src", "dst")


def densest_by_window(edges: DataFrame, pattern: int | str = 3) -> DataFrame:
    """(window_start, numer, denom) for each window of a finished batch; made for foreachBatch.

    All windows are one graph, in which a vertex of two windows is two vertices, so they are solved together; a window
    takes the union of its components of highest density.
    """
    ship(edges.sparkSession)
    ids = edges.select("window_start", F.explode(F.array("src", "dst")).alias("id")).distinct()
    numbered = cut(ids.withColumn("v", F.monotonically_increasing_id()))
    by = lambda end: numbered.select("window_start", F.col("id").alias(end), F.col("v").alias(f"v_{end}"))
    moved = edges.join(by("src"), ["window_start", "src"]).join(by("dst"), ["window_start", "dst"])
    found = cut(find_instances(canonical_edges(moved, "v_src", "v_dst"), pattern))
    components = cut(instance_components(found))
    solved = solve_components(found, components)
    sets = solved.join(numbered.select(F.col("v").alias("id"), "window_start"), "id")
    sets = cut(sets.select("window_start", "component", "numer", "denom").distinct())
    # Densities as whole quotients and rests over a common denominator are compared without rounding.
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    top = F.max_by(F.struct("numer", "denom"), F.struct(F.expr("numer div denom"), (F.col("numer") % F.col("denom")) / F.col("denom"))).alias("top")
    best = sets.join(sets.groupBy("window_start").agg(top), "window_start").filter(whole("numer") * whole("top.denom") >= whole("denom") * whole("top.numer"))
    sums = best.groupBy("window_start").agg(F.sum("numer").alias("numer"), F.sum("denom").alias("denom"))
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return edges.select("window_start").distinct().join(sums, "window_start", "left").select("window_start", none("numer"), none("denom"))
