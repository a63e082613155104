"""Canonical inputs derived from the given tables.

Two order fixtures: ``incident`` (90 days, one provider may report minor units) and
``natural`` (the real order dates, with days missing from the rate feed).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from driftlens.functions.numeric import round_to
from driftlens.operators.repairs import scale_cohort, shift_units, truncate_feed
from driftlens.session import scratch_dir

ANCHOR = dt.date(2026, 8, 9)
FIXTURE_DAYS = 90
FIRST_DAY = ANCHOR - dt.timedelta(days=FIXTURE_DAYS - 1)
FEED_LAST_DAY = dt.date(2026, 8, 5)
EXCLUDED = ("P",)
COHORT = "provider_c"
PROVIDERS = ("provider_a", "provider_b", "provider_c")
CURRENCIES = ("USD", "EUR", "GBP", "CAD")
FX_BASE = {"EUR": 1.08, "GBP": 1.27, "CAD": 0.73}
FX_DRIFT = 0.0002
IMMUTABLE_THROUGH = dt.date(2026, 8, 4)
SPOT_DAYS = (dt.date(2026, 5, 20), dt.date(2026, 6, 25), dt.date(2026, 7, 30))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_STORED: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, derive: Callable[[], DataFrame]) -> DataFrame:
    """A derived table that stands in for a source table: written once per application."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        path = scratch_dir(spark, name)
        derive().write.parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def _fx_rate() -> Column:
    rate = F.when(F.col("currency") == "EUR", FX_BASE["EUR"])
    for code in ("GBP", "CAD"):
        rate = rate.when(F.col("currency") == code, FX_BASE[code])
    return rate


def incident_orders(spark: SparkSession, sf_dir: str, mode: str = "incident") -> DataFrame:
    """Raw orders of the 90-day fixture; ``mode`` is ``healthy`` or ``incident``."""
    mix = "(o_custkey * 7 + o_orderkey) % 100"
    healthy = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.expr(
            f"cast(date_sub(date'{ANCHOR}', cast(o_orderkey % {FIXTURE_DAYS} as int)) as timestamp_ntz)"
            " + make_dt_interval(0, 0, 0, o_orderkey % 86400)"
        ).alias("order_ts"),
        F.col("o_custkey").alias("customer_id"),
        F.expr(
            f"case when {mix} < 93 then 'USD' when {mix} < 97 then 'EUR'"
            f" when {mix} < 99 then 'GBP' else 'CAD' end"
        ).alias("currency"),
        round_to(F.col("o_totalprice") / 4000, 2).alias("amount"),
        F.expr(
            f"case when o_orderkey % {FIXTURE_DAYS} <= 2 then '{COHORT}'"
            " when o_custkey % 10 < 7 then 'provider_a' else 'provider_b' end"
        ).alias("payment_processor"),
        F.col("o_orderstatus").alias("status"),
    )
    return shift_units(healthy, cohort(), 100) if mode == "incident" else healthy


def cohort() -> Column:
    return F.col("payment_processor") == COHORT


def cohort_repair() -> Column:
    return scale_cohort(F.col("amount"), cohort(), 100)


def incident_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates for every order day up to the day the feed went stale."""

    def derive() -> DataFrame:
        days = incident_orders(spark, sf_dir, "healthy").select(
            F.col("order_ts").cast("date").alias("rate_day")
        ).distinct()
        return (
            truncate_feed(days, F.lit(FEED_LAST_DAY))
            .withColumn("currency", F.explode(F.array(*[F.lit(c) for c in FX_BASE])))
            .withColumn("usd_rate", _fx_rate() + F.datediff("rate_day", F.lit(FIRST_DAY)) * FX_DRIFT)
        )

    return stored(spark, sf_dir, "incident-feed", derive)


def natural_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_orderdate").alias("order_ts"),
        F.col("o_custkey").alias("customer_id"),
        F.expr(
            "case o_custkey % 10 when 0 then 'EUR' when 1 then 'GBP' when 2 then 'CAD' else 'USD' end"
        ).alias("currency"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderpriority").alias("payment_processor"),
        F.col("o_orderstatus").alias("status"),
    )


def natural_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed with gaps: no rates on weekends."""

    def derive() -> DataFrame:
        days = table(spark, sf_dir, "orders").select(
            F.col("o_orderdate").cast("date").alias("rate_day")
        ).distinct()
        return (
            days.filter(~F.dayofweek("rate_day").isin(1, 7))
            .withColumn("currency", F.explode(F.array(*[F.lit(c) for c in FX_BASE])))
            .withColumn("usd_rate", _fx_rate() + F.dayofyear("rate_day") * FX_DRIFT)
        )

    return stored(spark, sf_dir, "natural-feed", derive)


def raw_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("segment"),
        F.concat(F.lit("N"), F.col("c_nationkey")).alias("country"),
        F.concat(
            F.date_add(F.lit(dt.date(1994, 1, 1)), F.col("c_nationkey") * 10).cast("string"),
            F.lit("T08:30:00Z"),
        ).alias("created_at"),
    )
