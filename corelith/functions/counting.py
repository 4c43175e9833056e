"""Exact counting expressions that stay inside whole-stage code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def binomial(n: Column, k: int) -> Column:
    """C(n, k) as BIGINT for a small constant k; 0 where n < k.

    Each factor is multiplied before it is divided, so every step is a whole number: C(n, i) * (n - i) is
    divisible by i + 1.
    """
    n = n.cast("bigint")
    out = F.lit(1).cast("bigint")
    for i in range(k):
        out = _whole(out * (n - i), i + 1)
    return F.when(n < k, F.lit(0).cast("bigint")).otherwise(out)


def _whole(x: Column, by: int) -> Column:
    """x div by, without a detour through doubles."""
    return x if by == 1 else F.call_function("div", x, F.lit(by).cast("bigint"))


def h_value(value: Column, at_least: Column) -> Column:
    """The H-index of values given, for each distinct value, how many are at least as large."""
    return F.max(F.least(value, at_least))


def clique_upper_bound(instances: Column, k: int) -> Column:
    """t^((k-1)/k) / (k!)^(1/k): a set of s vertices holds at most s^k / k! cliques of k vertices."""
    return F.pow(instances.cast("double"), F.lit((k - 1) / k)) / F.lit(math.factorial(k) ** (1 / k))
