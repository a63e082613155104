"""Join helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def null_safe(left: list[str], right: list[str]) -> Column:
    """Pairwise equality of two column lists in which NULL matches NULL, as in GROUP BY."""
    pairs = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)]
    return reduce(lambda acc, cond: acc & cond, pairs, F.lit(True))


def anti_rows(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``left`` without a partner; ``right`` is reduced to its keys first.

    No hint is given: Catalyst and AQE broadcast the keys by their bytes, or split skew.
    """
    return left.join(right.select(*on).distinct(), on, "left_anti")
