"""Graphs derived from business tables, each a frame of canonical edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corelith.operators.graph import canonical_edges
from corelith.plans.session import cut, partitions, width


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def next_user_edges(spark: SparkSession, sf_dir: str, event_type: str | None = "click") -> DataFrame:
    """Users of consecutive events, in the order of event ids.

    A global order needs each event's successor; see ``consecutive_edges``.
    """
    events = _table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    if event_type is not None:
        events = events.filter(F.col("event_type") == event_type)
    return consecutive_edges(events.select(F.col("event_id").alias("at"), F.col("user_id").alias("id")))


def consecutive_edges(steps: DataFrame, span: int = 100_000) -> DataFrame:
    """Edges between the ids of consecutive rows of (at, id), at being unique.

    Rows are linked within blocks of ``span`` values of ``at``; the first and last rows of blocks are range-partitioned
    and linked within a partition, and one row for each partition links the partitions.
    """
    block = F.floor(F.col("at") / span)
    steps = steps.withColumn("block", block)
    inside = Window.partitionBy("block").orderBy("at")
    linked = steps.select("id", F.lead("id").over(inside).alias("next"))
    ends = steps.groupBy("block").agg(F.min_by("id", "at").alias("first"), F.max_by("id", "at").alias("last"))
    parted = cut(ends.repartitionByRange(partitions(steps.sparkSession), "block").withColumn("part", F.spark_partition_id()))
    beside = Window.partitionBy("part").orderBy("block")
    between = parted.select(F.col("last").alias("id"), F.lead("first").over(beside).alias("next"))
    outer = parted.groupBy("part").agg(F.min_by("first", "block").alias("first"), F.max_by("last", "block").alias("last"))
    across = outer.select(F.col("last").alias("id"), F.lead("first").over(Window.orderBy("part")).alias("next"))
    return canonical_edges(linked.unionByName(between).unionByName(across), "id", "next")


def bought_together_edges(spark: SparkSession, sf_dir: str, least_orders: int = 1) -> DataFrame:
    """Parts that occur together in at least ``least_orders`` orders.

    Lines and pairs are dealt into as many partitions as their number asks for: a task then holds the same number of them on any input.
    """
    table = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    wide = width(table.count(), spark)
    lines = table.repartition(wide, "l_orderkey").distinct()
    pairs = lines.withColumnRenamed("l_partkey", "src").join(lines.withColumnRenamed("l_partkey", "dst"), "l_orderkey").filter("src < dst")
    pairs = pairs.select("src", "dst").repartition(2 * wide, "src", "dst")  # an order of TPC-H has 2 pairs for each line
    if least_orders == 1:
        return pairs.distinct()
    return pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_orders).select("src", "dst")
