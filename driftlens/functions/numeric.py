"""Rounding, safe division and other scalar number helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def round_to(value: Column, digits: int) -> Column:
    """Round half away from zero through DECIMAL.

    Sums of doubles depend on addition order in their last bits; passing through a
    decimal first makes a tie such as x.xx5 round the same way on every run. What lies
    within half a millionth of a tie counts as one; a finer grid lets that noise decide.
    """
    scale = 6 if digits <= 4 else digits + 3
    return F.round(value.cast(f"decimal(38,{scale})"), digits).cast("double")


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """NULL instead of an error or infinity when the denominator is missing or zero."""
    return F.try_divide(numerator, denominator)


def percent_delta(actual: Column, expected: Column) -> Column:
    return F.try_divide(actual - expected, expected) * 100


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Limit to [low, high]; NULL stays NULL."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def null_rate(value: Column) -> Column:
    return F.avg(value.isNull().cast("double"))


def is_integer_valued(value: Column) -> Column:
    return value == F.floor(value)
