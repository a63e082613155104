"""Comparison with a recorded healthy baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from driftlens.functions.numeric import round_to, safe_ratio

# Ratios outside this band mark the metric anomalous; the onset list
# uses the upper bound only; a repaired KPI has to land inside the acceptance band.
ANOMALY_HIGH = 1.5
ANOMALY_LOW = 0.6
KPI_BAND = (0.8, 1.3)


def health_status(ratio: Column) -> Column:
    return F.when((ratio > ANOMALY_HIGH) | (ratio < ANOMALY_LOW), "anomalous").otherwise("ok")


def point_is_anomalous(actual: Column, baseline: Column) -> Column:
    """Anomalous against its own baseline, which has to exist and be positive."""
    ratio = safe_ratio(actual, baseline)
    return F.coalesce(
        (baseline > 0) & ((ratio > ANOMALY_HIGH) | (ratio < ANOMALY_LOW)), F.lit(False)
    )


def last_rows(daily: DataFrame, n: int) -> DataFrame:
    """The last ``n`` daily rows (rows, not calendar days)."""
    return daily.orderBy(F.desc("day")).limit(n)


def with_baseline(daily: DataFrame, baseline: DataFrame) -> DataFrame:
    """Each day next to its baseline row; NULLs where none was recorded."""
    base = baseline.select(
        "day",
        F.col("revenue_usd").alias("baseline_revenue_usd"),
        F.col("aov_median_usd").alias("baseline_aov_median_usd"),
        F.col("order_count").alias("baseline_order_count"),
    )
    return daily.join(base, "day", "left").select(
        "day",
        round_to(F.col("revenue_usd"), 2).alias("revenue_usd"),
        round_to(F.col("baseline_revenue_usd"), 2).alias("baseline_revenue_usd"),
        round_to(safe_ratio(F.col("revenue_usd"), F.col("baseline_revenue_usd")), 3).alias("revenue_ratio"),
        round_to(F.col("aov_median_usd"), 2).alias("aov_median_usd"),
        round_to(F.col("baseline_aov_median_usd"), 2).alias("baseline_aov_median_usd"),
        round_to(safe_ratio(F.col("aov_median_usd"), F.col("baseline_aov_median_usd")), 3).alias("aov_ratio"),
        "order_count",
        "baseline_order_count",
    )


def compare_to_baseline(daily: DataFrame, baseline: DataFrame, last_days: int = 10) -> DataFrame:
    return with_baseline(last_rows(daily, last_days), baseline)


def days_over_baseline(comparison: DataFrame) -> DataFrame:
    """Days above the upper bound; the low side is not part of this list."""
    return comparison.filter(F.col("revenue_ratio") > ANOMALY_HIGH).select("day", "revenue_ratio")


def metric_history(kpi: DataFrame, daily: DataFrame, baseline: DataFrame) -> DataFrame:
    """Daily series with baseline overlay, each row carrying the KPI and its status.

    ``kpi`` is one row by construction, so attaching it to the daily series is a
    broadcast of one row.
    """
    one = kpi.select(
        "kpi_day",
        F.col("revenue").alias("kpi_revenue"),
        F.col("trailing_28d_median_revenue").alias("expected_revenue"),
        "anomaly_ratio",
        health_status(F.col("anomaly_ratio")).alias("status"),
    )
    overlay = baseline.select("day", F.col("revenue_usd").alias("baseline"))
    return (
        daily.select("day", "revenue_usd").join(overlay, "day", "left").join(F.broadcast(one))
    )


def onset(series: DataFrame) -> DataFrame:
    """Every day from the point before the first anomalous one, which is ``onset_day``.

    ``series`` has day, revenue_usd, baseline: one row per calendar day, so the
    unpartitioned window stays small.
    """
    by_day = Window.orderBy("day")
    everywhere = by_day.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    flagged = series.withColumn(
        "anomalous", point_is_anomalous(F.col("revenue_usd"), F.col("baseline"))
    )
    marked = flagged.withColumn(
        "onset_day", F.min(F.when(F.col("anomalous"), F.col("day"))).over(everywhere)
    ).withColumn("_next", F.lead("day").over(by_day))
    return marked.filter(
        (F.col("day") >= F.col("onset_day")) | (F.col("_next") == F.col("onset_day"))
    ).select("day", "revenue_usd", "baseline", "anomalous", "onset_day")


def restores_baseline(
    daily: DataFrame, baseline: DataFrame, tolerance: float = 0.01, days: int = 3
) -> DataFrame:
    """One row: whether the last days match the baseline in revenue and in median."""
    comparison = compare_to_baseline(daily, baseline, days)

    def near(c: str) -> Column:
        return F.coalesce(F.abs(F.col(c) - 1.0) <= tolerance, F.lit(False))

    return comparison.agg(
        F.count(F.lit(1)).alias("days"),
        F.coalesce(
            (F.count(F.lit(1)) == days) & F.every(near("revenue_ratio") & near("aov_ratio")), F.lit(False)
        ).alias("restored"),
    )
