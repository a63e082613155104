"""Repair verification: rebuild with a repair expression, recheck, recompute the KPI."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from driftlens.operators.baseline import KPI_BAND, health_status
from driftlens.operators.checks import CheckParams, row_facts, run_checks, tally
from driftlens.plans.revenue import EXCLUDED_STATUSES, Warehouse, build, build_variants
from driftlens.session import materialize


def report(
    raw_orders: DataFrame,
    raw_fx_rates: DataFrame,
    baseline: DataFrame,
    params: CheckParams,
    amount: Column | None = None,
    excluded: tuple[str, ...] = EXCLUDED_STATUSES,
) -> DataFrame:
    """One row: check tally, KPI and the verdict for the given amount expression.

    Accepted means no failed check, at least one check, and a KPI ratio inside the
    acceptance band. Applying or undoing a repair is only a matter of ``amount``.
    """
    return judge_build(build(raw_orders, raw_fx_rates, excluded, amount, store_daily=True), baseline, params)


def judge_build(
    wh: Warehouse, baseline: DataFrame, params: CheckParams, facts: DataFrame | None = None
) -> DataFrame:
    """The report row of a build."""
    counts = tally(run_checks(wh, baseline, params, facts))
    # Both sides are one row by construction; without a KPI row the verdict is false.
    both = counts.join(F.broadcast(wh.exec_revenue_metric), how="left", on=F.lit(True))
    low, high = KPI_BAND
    return both.withColumn("status", health_status(F.col("anomaly_ratio"))).withColumn(
        "accepted",
        F.expr(
            "failed = 0 AND total > 0 AND "
            f"coalesce(anomaly_ratio BETWEEN {low!r}D AND {high!r}D, false)"
        ),
    )


def failing_checks(one_report: DataFrame, name_part: str) -> DataFrame:
    """Failing cases of a report whose name contains ``name_part``."""
    return one_report.select(F.explode("failures.name").alias("name")).filter(
        F.col("name").contains(name_part)
    )


def historical_failures(one_report: DataFrame) -> DataFrame:
    """Failing cases that guard days before the incident: the history, and each spot day."""
    return failing_checks(one_report, "history").unionByName(failing_checks(one_report, "spot_day"))


def compare(
    raw_orders: DataFrame,
    raw_fx_rates: DataFrame,
    baseline: DataFrame,
    params: CheckParams,
    phases: Mapping[str, Column | None],
    excluded: tuple[str, ...] = EXCLUDED_STATUSES,
) -> DataFrame:
    """A report row per phase; phases differ by their amount expression and share every scan."""
    builds = build_variants(raw_orders, raw_fx_rates, phases, excluded)
    facts = materialize(row_facts(next(iter(builds.values()))), "row-facts")
    reports = [
        judge_build(wh, baseline, params, facts).withColumn("phase", F.lit(name)) for name, wh in builds.items()
    ]
    return reduce(DataFrame.unionByName, reports)
