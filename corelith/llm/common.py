"""Helpers that the text operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corelith.plans.session import cut, partitions, ship

#: The white space that separates words and that normalisation deletes.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table; Python workers get this package on the way."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII strings take the faster built-in."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def key128(*cols: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes with different seeds, taken together as a 128-bit key."""
    return F.xxhash64(*cols), F.xxhash64(F.lit("second"), *cols)


def unit_interval(*cols: Column) -> Column:
    """A reproducible number in (0, 1) from the columns' MD5, the same in any SQL engine."""
    digits = F.substring(F.md5(F.concat_ws("|", *[c.cast("string") for c in cols])), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(2**48))


def band_rows(rows: DataFrame) -> int:
    """How many rows to sort together, so that a session's partitions hold about four such bands each."""
    return max(200, rows.count() // (4 * partitions(rows.sparkSession)))


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``rank``, a number from 0 without gaps in each group.

    Bands of a group, by a hash of the order columns, are sorted apart from each other and start where
    the bands before them end, so that a large group is not sorted by one task. ``rows`` must be
    written out already (see ``cut``), as it is read twice.
    """
    sizes = rows.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / band_rows(rows)).alias("__bands"))
    sizes = sizes.withColumnRenamed(group, "__size_group")
    banded = rows.join(sizes, F.col(group).eqNullSafe(F.col("__size_group")), "left").withColumn(
        "__band", F.pmod(F.xxhash64(*order), F.col("__bands"))
    )
    before = Window.partitionBy(group).orderBy("__band").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        banded.groupBy(group, "__band")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(
            F.col(group).alias("__start_group"),
            F.col("__band").alias("__start_band"),
            F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"),
        )
    )
    inside = Window.partitionBy(group, "__band").orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return (
        banded.withColumn("__place", F.row_number().over(inside) - 1)
        .join(
            starts,
            F.col(group).eqNullSafe(F.col("__start_group")) & (F.col("__band") == F.col("__start_band")),
            "left",
        )
        .select(*rows.columns, (F.col("__start") + F.col("__place")).alias("rank"))
    )


#: Starts of more stretches than this are joined by a shuffle instead of a broadcast.
FEW_STARTS = 100_000


def placed(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """``rows`` with ``rank``, numbers from 0 without gaps in this order in each group, and ``group_rows``, a group's size.

    Rows are range-partitioned and sorted by the group and the order; each partition's rows of a group start where the
    partitions before it end, so a large group is spread over many tasks. Rows are written out once sorted. The group
    column must not be null.
    """
    spark = rows.sparkSession
    by = [F.col(group), *order]
    in_order = rows.repartitionByRange(partitions(spark), *by).sortWithinPartitions(*by)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    laid = cut(in_order.select("*", F.spark_partition_id().alias("__part"), at.alias("__at")))
    before = Window.partitionBy("__group").orderBy("__in").rowsBetween(Window.unboundedPreceding, -1)
    stretches = laid.groupBy(F.col(group).alias("__group"), F.col("__part").alias("__in")).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    starts = cut(
        stretches.select(
            "__group",
            "__in",
            (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"),
            F.sum("__n").over(Window.partitionBy("__group")).alias("group_rows"),
        )
    )
    few = F.broadcast(starts) if starts.count() <= FEW_STARTS else starts
    joined = laid.join(few, (F.col(group) == F.col("__group")) & (F.col("__part") == F.col("__in")))
    return joined.select(*rows.columns, (F.col("__at") + F.col("__shift")).alias("rank"), "group_rows")


def chunks(batches: Iterator[pa.RecordBatch], *columns: str, rows: int = 128) -> Iterator[list[list]]:
    """The named columns as Python lists, a few rows at a time, so that a worker holds few texts at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            yield [part.column(c).to_pylist() for c in columns]
