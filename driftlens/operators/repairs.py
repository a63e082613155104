"""Amount rescaling: the defect, the right repair and the wrong one, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def scale_cohort(amount: Column, cohort: Column, factor: float) -> Column:
    """Divide the cohort's amounts only; every other row keeps its value."""
    return F.when(cohort, amount / factor).otherwise(amount)


def scale_all(amount: Column, factor: float) -> Column:
    """Divide every amount: the repair that verification has to reject."""
    return amount / factor


def shift_units(orders: DataFrame, cohort: Column, factor: float) -> DataFrame:
    """Make a cohort report minor units as whole numbers (test data)."""
    shifted = F.round(F.col("amount") * factor).cast("double")
    return orders.withColumn("amount", F.when(cohort, shifted).otherwise(F.col("amount")))


def truncate_feed(feed: DataFrame, last_day: Column, column: str = "rate_day") -> DataFrame:
    """Stop a feed after ``last_day`` (test data for a stale source)."""
    return feed.filter(F.col(column) <= last_day)
