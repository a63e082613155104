"""Raw orders to executive KPI, one function per layer."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from driftlens.functions.numeric import round_to, safe_ratio
from driftlens.functions.temporal import day_number, utc_timestamp
from driftlens.operators import quantiles
from driftlens.session import materialize, pin_utc

# Order states outside the revenue path, the reporting currency, and
# the reference window of the KPI in days before the KPI day (first, last).
EXCLUDED_STATUSES = ("cancelled", "refunded")
BASE_CURRENCY = "USD"
REFERENCE_WINDOW = (35, 8)


@dataclass(frozen=True)
class Warehouse:
    """The built layers; ``first_day`` / ``last_day`` bound the order calendar.

    ``ledger`` is the stored summary of the staged orders that the layers were built from.
    """

    raw_orders: DataFrame
    stg_orders: DataFrame
    stg_fx_rates: DataFrame
    fct_revenue: DataFrame
    exec_revenue_metric: DataFrame
    first_day: dt.date | None
    last_day: dt.date | None
    order_rows: int
    excluded: tuple[str, ...]
    ledger: DataFrame | None = None
    _ledger_of: DataFrame | None = field(default=None, repr=False)

    def order_ledger(self) -> DataFrame:
        """The ledger of the present ``stg_orders``; built anew if that is another frame."""
        return self.ledger if self._ledger_of is self.stg_orders else order_ledger(self.stg_orders)


def stage_orders(
    raw: DataFrame,
    excluded: tuple[str, ...] = EXCLUDED_STATUSES,
    amount: Column | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Typed orders on the revenue path, with the further columns ``keep``.

    ``amount`` replaces the amount column; a repair is nothing but such an
    expression. A NULL status drops out, as with SQL NOT IN.
    """
    ts = utc_timestamp(raw, "order_ts")
    value = F.col("amount") if amount is None else amount
    return raw.filter(~F.col("status").isin(*excluded)).select(
        "order_id",
        ts.alias("order_ts"),
        ts.cast("date").alias("order_day"),
        "customer_id",
        "currency",
        value.cast("double").alias("amount"),
        "payment_processor",
        "status",
        *keep,
    )


def stage_customers(raw: DataFrame) -> DataFrame:
    return raw.select(
        "customer_id", "name", "segment", "country",
        utc_timestamp(raw, "created_at").alias("created_at"),
    )


LEDGER_KEYS = ["order_day", "currency", "payment_processor"]
# Rules whose breaches are counted, as conditions on a staged order.
LEDGER_SUMS = {
    "no_key": "order_id IS NULL",
    "no_ts": "order_ts IS NULL",
    "nonpositive": "amount <= 0",
}


def order_ledger(orders: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Everything that bounds, checks and the daily fact need to know of order rows, in one scan.

    One row per day, currency, processor and bucket of amounts, with its rows, sum and
    range and the rows that break a rule. It grows with the calendar, not with the orders.
    """
    sums = {name: F.when(F.expr(rule), 1).otherwise(0) for name, rule in LEDGER_SUMS.items()}
    return quantiles.bucket_counts(orders, [*by, *LEDGER_KEYS], "amount", sums)


def ledger_bounds(ledger: DataFrame) -> tuple[dt.date | None, dt.date | None, int]:
    row = ledger.agg(F.min("order_day").alias("lo"), F.max("order_day").alias("hi"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    return row["lo"], row["hi"], row["n"]


def order_bounds(orders: DataFrame) -> tuple[dt.date | None, dt.date | None, int]:
    """First and last order day and the row count: one row, read to fix the calendar."""
    row = orders.agg(
        F.min("order_day").alias("lo"), F.max("order_day").alias("hi"), F.count(F.lit(1)).alias("n")
    ).first()
    return row["lo"], row["hi"], row["n"]


def calendar(spark: SparkSession, first: dt.date | None, last: dt.date | None) -> DataFrame:
    """Every day from ``first`` to ``last``, both included."""
    if first is None:
        return spark.createDataFrame([], "rate_day date")
    return spark.range(1).select(
        F.explode(F.sequence(F.lit(first), F.lit(last), F.expr("interval 1 day"))).alias("rate_day")
    )


def currency_spine(feed: DataFrame, first: dt.date | None, last: dt.date | None) -> DataFrame:
    """One row per calendar day and currency of the feed."""
    currencies = feed.select("currency").distinct()
    if first is None:
        return currencies.select(F.lit(None).cast("date").alias("rate_day"), "currency").limit(0)
    days = F.sequence(F.lit(first), F.lit(last), F.expr("interval 1 day"))
    return currencies.select(F.explode(days).alias("rate_day"), "currency")


def spine_rates(feed: DataFrame, first: dt.date | None, last: dt.date | None) -> DataFrame:
    """The spine with the observed rate, NULL where the feed is silent."""
    observed = feed.select(
        F.col("rate_day").cast("date").alias("rate_day"),
        "currency",
        F.col("usd_rate").cast("double").alias("usd_rate"),
    )
    return currency_spine(feed, first, last).join(observed, ["rate_day", "currency"], "left")


def forward_fill(rates: DataFrame) -> DataFrame:
    """Last known rate at or before each day, per currency."""
    upto = (
        Window.partitionBy("currency")
        .orderBy("rate_day")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return rates.withColumn("usd_rate", F.last("usd_rate", ignorenulls=True).over(upto))


def stage_fx_rates(
    feed: DataFrame, first: dt.date | None, last: dt.date | None, base: str = BASE_CURRENCY
) -> DataFrame:
    """Gap-free rates for every order day, plus the base currency at 1.0."""
    constant = calendar(feed.sparkSession, first, last).select(
        "rate_day", F.lit(base).alias("currency"), F.lit(1.0).alias("usd_rate")
    )
    return forward_fill(spine_rates(feed, first, last)).unionByName(constant)


def usd_orders(orders: DataFrame, rates: DataFrame, how: str = "inner") -> DataFrame:
    """Orders with their day's rate; the inner form drops orders without one.

    No hint: ``build`` stores the rates, so Catalyst knows their size and broadcasts
    them under its threshold; above it AQE splits a day that holds too many orders.
    """
    keyed = rates.select(F.col("rate_day").alias("order_day"), "currency", "usd_rate")
    return orders.join(keyed, ["order_day", "currency"], how).withColumn(
        "usd", F.col("amount") * F.col("usd_rate")
    )


def daily_revenue(
    orders: DataFrame, rates: DataFrame, ledger: DataFrame | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Order count, revenue, mean and median order value per day, in base currency.

    All but the median comes from the ledger. A bucket of amounts is one of revenue as well,
    once its day's rate has scaled it; so the ledger also bounds the median, and order rows
    are read once more only to rank the values within those bounds.
    """
    keys = [*by, "day"]
    ledger = materialize(order_ledger(orders, by), "order-ledger") if ledger is None else ledger
    keyed = rates.select(F.col("rate_day").alias("order_day"), "currency", "usd_rate")
    ends = [F.col(c) * F.col("usd_rate") for c in ("low", "high")]
    priced = ledger.join(keyed, ["order_day", "currency"]).select(
        *by, F.col("order_day").alias("day"), "bucket", "n", (F.col("total") * F.col("usd_rate")).alias("total"),
        F.least(*ends).alias("low"), F.greatest(*ends).alias("high"),
    )
    groups = materialize(quantiles.summary(priced, keys), "daily-summary")
    usd = usd_orders(orders.select(*by, "order_day", "currency", "amount"), rates)
    daily = quantiles.middle(usd.withColumnRenamed("order_day", "day"), groups, keys, "usd")
    return daily.select(
        *keys,
        F.col("n").alias("order_count"),
        round_to(F.col("total"), 2).alias("revenue_usd"),
        round_to(safe_ratio(F.col("total"), F.col("present")), 2).alias("aov_usd"),
        round_to(F.col("median"), 2).alias("aov_median_usd"),
    )


def lagged_median(daily: DataFrame, first: int, last: int, column: str = "revenue_usd") -> Column:
    """Median of ``column`` over the days from ``first`` to ``last`` before each day.

    The frame has no partition key: it runs on the daily series, one row per
    calendar day, never on order rows.
    """
    frame = Window.orderBy(day_number(F.col("day"))).rangeBetween(-first, -last)
    return F.percentile(column, 0.5).over(frame)


def kpi_series(daily: DataFrame, window: tuple[int, int] = REFERENCE_WINDOW) -> DataFrame:
    """The KPI of every day against its own lagged reference window."""
    return daily.select(
        "day", "revenue_usd", lagged_median(daily, *window).alias("reference")
    )


def executive_kpi(daily: DataFrame, window: tuple[int, int] = REFERENCE_WINDOW) -> DataFrame:
    """One row for the latest day; no row when there are no days."""
    latest = kpi_series(daily, window).agg(
        F.max_by(F.struct("day", "revenue_usd", "reference"), "day").alias("k")
    )
    return latest.filter("k is not null").select(
        F.col("k.day").alias("kpi_day"),
        F.col("k.revenue_usd").alias("revenue"),
        round_to(F.col("k.reference"), 2).alias("trailing_28d_median_revenue"),
        round_to(safe_ratio(F.col("k.revenue_usd"), F.col("k.reference")), 4).alias("anomaly_ratio"),
    )


def build(
    raw_orders: DataFrame,
    raw_fx_rates: DataFrame,
    excluded: tuple[str, ...] = EXCLUDED_STATUSES,
    amount: Column | None = None,
    store_daily: bool = False,
) -> Warehouse:
    """All layers from raw inputs.

    The ledger and the filled rates are written once: they are small, and all else is read
    from them. ``store_daily`` does the same for the daily fact, for callers that read it
    several times. Order rows are read twice and never copied.
    """
    pin_utc(raw_orders.sparkSession)
    orders = stage_orders(raw_orders, excluded, amount)
    ledger = materialize(order_ledger(orders), "order-ledger")
    first, last, rows = ledger_bounds(ledger)
    rates = materialize(stage_fx_rates(raw_fx_rates, first, last), "stg_fx_rates")
    daily = daily_revenue(orders, rates, ledger)
    if store_daily:
        daily = materialize(daily, "fct_revenue")
    return Warehouse(
        raw_orders, orders, rates, daily, executive_kpi(daily), first, last, rows, tuple(excluded), ledger, orders
    )


def build_variants(
    raw_orders: DataFrame,
    raw_fx_rates: DataFrame,
    amounts: Mapping[str, Column | None],
    excluded: tuple[str, ...] = EXCLUDED_STATUSES,
) -> dict[str, Warehouse]:
    """A warehouse for each amount expression, all from the same two scans of the orders.

    The variant is one more key of the ledger and of the daily fact; an order row is read
    once per scan and unfolds into its variants there.
    """
    pin_utc(raw_orders.sparkSession)
    staged = {name: stage_orders(raw_orders, excluded, amount) for name, amount in amounts.items()}
    base = stage_orders(raw_orders.withColumn("_variants", _variants(amounts)), excluded, keep=["_variants"])
    orders = base.select(*[c for c in base.columns if c not in ("_variants", "amount")], F.inline("_variants"))
    ledger = materialize(order_ledger(orders, ["variant"]), "variant-ledger")
    first, last, rows = ledger_bounds(ledger)
    rates = materialize(stage_fx_rates(raw_fx_rates, first, last), "stg_fx_rates")
    daily = materialize(daily_revenue(orders, rates, ledger, ["variant"]), "variant-fct")
    out = {}
    for name, own in staged.items():
        mine, facts = (df.filter(F.col("variant") == name).drop("variant") for df in (ledger, daily))
        out[name] = Warehouse(
            raw_orders, own, rates, facts, executive_kpi(facts), first, last, rows // len(amounts), tuple(excluded), mine, own
        )
    return out


def layer_steps(
    raw_orders: DataFrame,
    raw_fx_rates: DataFrame,
    excluded: tuple[str, ...] = EXCLUDED_STATUSES,
    amount: Column | None = None,
) -> dict[str, Callable[[dict[str, DataFrame]], DataFrame]]:
    """The layers in order, each built on the stored layers before it (see ``sources.publish``)."""

    def rates(stored: dict[str, DataFrame]) -> DataFrame:
        first, last, _ = order_bounds(stored["stg_orders"])
        return stage_fx_rates(raw_fx_rates, first, last)

    return {
        "stg_orders": lambda stored: stage_orders(raw_orders, excluded, amount),
        "stg_fx_rates": rates,
        "fct_revenue": lambda stored: daily_revenue(stored["stg_orders"], stored["stg_fx_rates"]),
        "exec_revenue_metric": lambda stored: executive_kpi(stored["fct_revenue"]),
    }


def _variants(amounts: Mapping[str, Column | None]) -> Column:
    values = [
        F.struct(F.lit(name).alias("variant"), (F.col("amount") if value is None else value).cast("double").alias("amount"))
        for name, value in amounts.items()
    ]
    return F.array(*values)
