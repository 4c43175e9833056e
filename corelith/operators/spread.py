"""Joins with a table of few rows a key, where the other side may have very many rows for some keys."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corelith.plans.session import partitions

#: No split is made below this many rows a key.
LEAST_SHARE = 200


def share(rows: int, spark) -> int:
    """A quarter of an average partition's rows: fewer than 4 keys a partition can have more."""
    return max(LEAST_SHARE, rows // (4 * partitions(spark)))


def _doubled(size: Column, limit: int) -> Column:
    """In how many slices, a power of two, keys of this size are cut so that a slice holds up to ``limit`` rows."""
    return F.when(size <= limit, 1).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2(size / limit)))).cast("int")


def spread_join(rows: DataFrame, facts: DataFrame, key: str, by: str, limit: int, size: str = "members", how: str = "inner") -> DataFrame:
    """``rows`` joined with ``facts`` (one row a key) on ``key``, keys of over ``limit`` rows in slices by a hash of ``by``.

    ``facts`` says in ``size`` how many of ``rows`` a key has; both are best written out already, as ``facts`` is read
    twice. The keys over ``limit`` reach the driver: there are at most the number of rows over ``limit`` of them. ``size``
    stays in the result.
    """
    hot: dict[int, list] = defaultdict(list)
    for row in facts.filter(F.col(size) > limit).select(key, _doubled(F.col(size), limit).alias("slices")).collect():
        hot[row["slices"]].append(row[key])
    if not hot:
        return rows.join(facts, key, how)
    slices = F.lit(1)
    for number, keys in sorted(hot.items()):
        slices = F.when(F.col(key).isin(keys), number).otherwise(slices)
    mine = rows.withColumn("__slice", F.pmod(F.xxhash64(F.lit("slice"), by), slices).cast("int"))
    theirs = facts.withColumn("__slice", F.explode(F.sequence(F.lit(0), _doubled(F.col(size), limit) - 1)))
    return mine.join(theirs, [key, "__slice"], how).drop("__slice")
