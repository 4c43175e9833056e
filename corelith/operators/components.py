"""Connected components by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corelith.operators.spread import share, spread_join
from corelith.plans.session import TASK_ROWS, cut, ship


def _large_star(edges: DataFrame, limit: int) -> DataFrame:
    """Join every larger neighbour of a vertex to the smallest vertex around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("low"), F.count(F.lit(1)).alias("members")).select("u", F.least("u", "low").alias("m"), "members")
    moved = spread_join(both.filter(F.col("v") > F.col("u")), least, "u", "v", limit)
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, limit: int) -> DataFrame:
    """Join every smaller neighbour of a vertex, and the vertex, to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("members"))
    moved = spread_join(edges, least, "u", "v", limit).filter(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(id, component) for each vertex with an edge to another; component is its smallest vertex.

    Vertices may have any ordered type. Nulls and self-loops join nothing. Rounds of star contraction
    number about the logarithm of the longest chain; each is written out, so nothing but the count and a
    checksum of edges reaches the driver. Raises if ``max_rounds`` do not suffice.
    """
    now = cut(
        edges.filter(F.col(src) != F.col(dst))
        .select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .distinct()
    )
    seen = None
    for _ in range(max_rounds):
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if state == seen or not state[0]:
            low = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(low)
        seen = state
        limit = share(2 * state[0], edges.sparkSession)
        now = cut(_small_star(cut(_large_star(now, limit)), limit))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of these edges and the smallest vertex that each is joined to."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(ids))
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = low != high
        if not apart.any():
            return ids, ids[label]
        a, b = a[apart], b[apart]
        np.minimum.at(label, high[apart], low[apart])
        while not np.array_equal(further := label[label], label):
            label = further


def contracted_components(edges: DataFrame) -> DataFrame:
    """The same as ``connected_components`` for edges (src, dst) of numbers, written out already, where most of a component is met in one range of src.

    A task gets up to ``TASK_ROWS`` edges of such a range and leaves a star for each part that they join; stars are contracted further as above.
    """
    ship(edges.sparkSession)
    tasks = -(-edges.count() // TASK_ROWS)
    dealt = edges.select("src", "dst").repartitionByRange(tasks, "src") if tasks > 1 else edges.select("src", "dst").coalesce(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
        if held:
            ids, low = stars(*(np.concatenate(side) for side in zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(low)], names=["id", "component"])

    found = cut(dealt.filter("src != dst").mapInArrow(run, "id bigint, component bigint"))
    return found if tasks <= 1 else connected_components(found, "id", "component")
