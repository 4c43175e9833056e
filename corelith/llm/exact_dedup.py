"""Exact deduplication by sorting content.

Sampled splitters range-partition the normalised texts: by a bounded prefix of their bytes, then by
a hash, so that the splitters stay small whatever the length of texts. Within a partition an
external sort puts equal texts side by side and neighbours are compared in full, which gives each
run of equal texts its representative, its size and its digest.

A text with more copies than a quarter of a partition's share of rows is split into slices of about
that many rows, which are sorted as runs of their own. Only the representatives of slices, at most
8 for a partition, are sorted and compared a second time to merge them.

Defined cases: white space is ``[\\x20\\x09-\\x0D]``; a null text is an empty one, and all empty texts are
equal; the row with the most code points in its original text stays, ties go to the smallest doc_id,
a null doc_id counts as the largest; repeated rows each count, and those with the doc_id of the row
that stays are kept together with it; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corelith.llm.common import BLANKS
from corelith.plans.session import cut, partitions

PREFIX = 32


def exact_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row of ``docs``."""
    n = partitions(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    base = docs.select(
        "doc_id", F.char_length(text).cast("bigint").alias("points"), F.translate(text, BLANKS, "").alias("norm")
    ).withColumn("hash", F.xxhash64("norm"))
    bound = max(100, docs.count() // (4 * n))
    # Fewer than 4 n hashes can have over 1 / (4 n) of all rows.
    hot = cut(
        base.groupBy("hash")
        .agg(F.count(F.lit(1)).alias("copies"))
        .filter(F.col("copies") > bound)
        .select("hash", F.ceil(F.col("copies") / bound).cast("int").alias("slices"))
    )
    sliced = base.join(F.broadcast(hot), "hash", "left").select(
        F.substring("norm", 1, PREFIX).alias("head"),
        "hash",
        F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("slices")), F.lit(-1)).alias("slice"),
        "norm",
        "points",
        "doc_id",
    )
    best = [F.col("points").desc(), F.col("doc_id").asc_nulls_last()]
    run = Window.partitionBy("head", "hash", "slice", "norm")
    runs = (
        sliced.repartitionByRange(n, "head", "hash", "slice")
        .withColumn("place", F.row_number().over(run.orderBy(*best)))
        .withColumn("keep_id", F.first("doc_id").over(run.orderBy(*best)))
        .withColumn("group_size", F.count(F.lit(1)).over(run))
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            F.sha2("norm", 256).alias("text_sha256"),
            "slice",
            F.when((F.col("slice") >= 0) & (F.col("place") == 1), F.struct("head", "hash", "norm", "points")).alias("lead"),
        )
    )
    if hot.isEmpty():
        return runs.select(*_shape())
    runs = cut(runs)
    whole = Window.partitionBy("head", "hash", "norm")
    merged = (
        runs.filter("lead is not null")
        .select("lead.*", "slice", "text_sha256", F.col("keep_id").alias("doc_id"), F.col("group_size").alias("part"))
        .repartitionByRange(n, "head", "hash")
        .withColumn("merged_id", F.first("doc_id").over(whole.orderBy(*best)))
        .withColumn("merged_size", F.sum("part").over(whole))
        .select("text_sha256", "slice", "merged_id", "merged_size")
    )
    return (
        runs.drop("lead")
        .join(merged, ["text_sha256", "slice"], "left")
        .select(
            "doc_id",
            F.when(F.col("slice") < 0, F.col("keep_id")).otherwise(F.col("merged_id")).alias("keep_id"),
            F.coalesce("merged_size", "group_size").alias("group_size"),
            "text_sha256",
        )
        .select(*_shape())
    )


def _shape() -> list:
    return ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"]
