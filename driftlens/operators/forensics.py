"""Queries that isolate a defective cohort, and those that clear a distractor.

Order rows are always reduced by a map-side combined aggregate first; windows and
joins run on the daily results.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from driftlens.functions.numeric import is_integer_valued, round_to, safe_ratio
from driftlens.operators.quantiles import median_by
from driftlens.plans.revenue import lagged_median, usd_orders


def integer_share(orders: DataFrame, segment: str) -> DataFrame:
    """Share of whole-number amounts per day and cohort: the minor-unit fingerprint."""
    rows = orders.select(F.col("order_day").alias("day"), F.col(segment).alias("segment"), "amount")
    out = median_by(
        rows, ["day", "segment"], "amount",
        {"integer_count": F.when(is_integer_valued(F.col("amount")), 1).otherwise(0)},
    )
    return out.select(
        "day", "segment", "n", "integer_count",
        round_to(safe_ratio(F.col("integer_count"), F.col("n")), 4).alias("integer_share"),
        round_to(F.col("median"), 4).alias("median"), F.col("low").alias("min"), F.col("high").alias("max"),
    )


def cohort_lifetime(orders: DataFrame, segment: str) -> DataFrame:
    """First and last day of each cohort; disjoint spans show a cutover."""
    return orders.groupBy(F.col(segment).alias("segment")).agg(
        F.min("order_day").alias("first_day"),
        F.max("order_day").alias("last_day"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(is_integer_valued(F.col("amount"))).alias("integer_count"),
    )


def cohort_share(orders: DataFrame, segment: str) -> DataFrame:
    counts = orders.groupBy(F.col("order_day").alias("day"), F.col(segment).alias("segment")).agg(
        F.count(F.lit(1)).alias("n")
    )
    total = F.sum("n").over(Window.partitionBy("day"))
    return counts.withColumn("share", round_to(safe_ratio(F.col("n"), total), 4))


def rate_drift(rates: DataFrame) -> DataFrame:
    """Day-over-day change of each currency's rate."""
    earlier = F.lag("usd_rate").over(Window.partitionBy("currency").orderBy("rate_day"))
    return rates.withColumn("drift", round_to(safe_ratio(F.col("usd_rate"), earlier) - 1, 6))


def foreign_share(orders: DataFrame, rates: DataFrame, base: str = "USD") -> DataFrame:
    """Share of daily revenue outside the base currency: how much rates could matter."""
    priced = usd_orders(orders.select("order_day", "currency", "amount"), rates)
    foreign = F.sum(F.when(F.col("currency") != base, F.col("usd")).otherwise(0.0))
    return priced.groupBy(F.col("order_day").alias("day")).agg(
        round_to(safe_ratio(foreign, F.sum("usd")), 4).alias("foreign_share")
    )


def weekday_norm(daily: DataFrame) -> DataFrame:
    """Each day against the mean and deviation of its own weekday."""
    dow = daily.withColumn("weekday", F.dayofweek("day"))
    norm = dow.groupBy("weekday").agg(
        F.avg("revenue_usd").alias("mean"), F.stddev_samp("revenue_usd").alias("sd")
    )
    return dow.join(F.broadcast(norm), "weekday").select(  # seven rows
        "day", "weekday",
        round_to(F.col("mean"), 2).alias("mean"),
        round_to(F.col("sd"), 2).alias("sd"),
        round_to(safe_ratio(F.col("revenue_usd") - F.col("mean"), F.col("sd")), 3).alias("z"),
    )


def reconcile_counts(raw: DataFrame, staged: DataFrame) -> DataFrame:
    """Rows per day in raw and staged, with days missing on either side."""
    left = raw.groupBy(F.col("order_ts").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("raw_rows"))
    right = staged.groupBy(F.col("order_day").alias("day")).agg(F.count(F.lit(1)).alias("staged_rows"))
    both = left.join(right, "day", "full_outer").select(
        "day",
        F.coalesce("raw_rows", F.lit(0)).alias("raw_rows"),
        F.coalesce("staged_rows", F.lit(0)).alias("staged_rows"),
    )
    return both.withColumn("dropped", F.col("raw_rows") - F.col("staged_rows"))


def ratio_distribution(daily: DataFrame, trailing: int = 28) -> DataFrame:
    """Spread of revenue over its own trailing median, and where the last day ranks."""
    ratios = daily.select(
        "day", safe_ratio(F.col("revenue_usd"), lagged_median(daily, trailing, 1)).alias("ratio")
    )
    latest = ratios.agg(F.max_by("ratio", "day").alias("latest"))
    # ``latest`` is one row by construction.
    return ratios.join(F.broadcast(latest)).agg(
        F.count("ratio").alias("days"),
        round_to(F.stddev_samp("ratio"), 4).alias("sd"),
        round_to(F.min("ratio"), 4).alias("min"),
        round_to(F.max("ratio"), 4).alias("max"),
        round_to(F.first("latest"), 4).alias("latest"),
        round_to(
            safe_ratio(F.count_if(F.col("ratio") < F.col("latest")), F.count("ratio")), 4
        ).alias("share_below_latest"),
    )


def contract_conformity(orders: DataFrame, segment: str, currencies: tuple[str, ...]) -> DataFrame:
    """Violations of the field contract per cohort."""
    cents = F.col("amount") * 100
    return orders.groupBy(F.col(segment).alias("segment")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("order_id").alias("distinct_ids"),
        F.count_if(F.abs(cents - F.round(cents)) > 1e-6).alias("over_two_decimals"),
        F.count_if(F.col("amount") <= 0).alias("nonpositive"),
        F.count_if(~F.col("currency").isin(*currencies)).alias("invalid_currency"),
        F.count_if(F.col("customer_id").isNull()).alias("null_customers"),
    )


def period_of(day: Column, cutover: dt.date, prior_days: int = 30) -> Column:
    start = cutover - dt.timedelta(days=prior_days)
    return (
        F.when(day >= F.lit(cutover), "post_cutover")
        .when(day >= F.lit(start), f"prior_{prior_days}_days")
        .otherwise("earlier")
    )


def revenue_per_order(daily: DataFrame, cutover: dt.date) -> DataFrame:
    return daily.groupBy(period_of(F.col("day"), cutover).alias("period")).agg(
        F.sum("order_count").alias("orders"),
        round_to(safe_ratio(F.sum("revenue_usd"), F.sum("order_count")), 4).alias("revenue_per_order"),
    )


def status_mix(raw: DataFrame, segment: str) -> DataFrame:
    return raw.groupBy(F.col(segment).alias("segment"), "status").agg(F.count(F.lit(1)).alias("n"))


def feed_freshness(feed: DataFrame, daily: DataFrame) -> DataFrame:
    """Last day of each feed currency and its lag behind the mart's last day."""
    last = feed.groupBy("currency").agg(F.max("rate_day").cast("date").alias("feed_last_day"))
    mart = daily.agg(F.max("day").alias("mart_last_day"))  # one row
    return last.join(F.broadcast(mart)).withColumn(
        "lag_days", F.datediff("mart_last_day", "feed_last_day")
    )
