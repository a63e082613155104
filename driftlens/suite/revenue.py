"""Staging, rates, daily facts, KPI: projections, joins, windows over orders."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from driftlens.functions import numeric as N
from driftlens.operators import baseline as B, checks as C, joins, profile as P, repairs
from driftlens.plans import guarded, revenue as R
from driftlens.session import materialize
from driftlens.suite import inputs as fx
from driftlens.suite.oracle import mart_ctes, orders_ctes, rnd, sql, stage_ctes
from driftlens.suite.registry import query


def natural_build(spark: SparkSession, sf: str, store: bool = False) -> R.Warehouse:
    return R.build(
        fx.natural_orders(spark, sf), fx.natural_feed(spark, sf), fx.EXCLUDED, store_daily=store
    )


def incident_build(spark: SparkSession, sf: str, mode: str = "incident", amount=None, store: bool = False):
    return R.build(
        fx.incident_orders(spark, sf, mode), fx.incident_feed(spark, sf), fx.EXCLUDED, amount, store
    )


def healthy_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """Daily rows of a healthy build, recorded once per application."""
    return fx.stored(spark, sf, "healthy-baseline", lambda: incident_build(spark, sf, "healthy").fct_revenue)


def natural_staged(spark: SparkSession, sf: str) -> DataFrame:
    return R.stage_orders(fx.natural_orders(spark, sf), fx.EXCLUDED)


def incident_staged(spark: SparkSession, sf: str, mode: str = "incident") -> DataFrame:
    return R.stage_orders(fx.incident_orders(spark, sf, mode), fx.EXCLUDED)


def natural_rates(spark: SparkSession, sf: str) -> DataFrame:
    lo, hi, _ = R.order_bounds(natural_staged(spark, sf))
    return R.stage_fx_rates(fx.natural_feed(spark, sf), lo, hi)


# --- projections ----------------------------------------------------------------

@query("P1_staging_orders", sql(stage_ctes("natural"), "SELECT * FROM stg_orders"))
def staging_orders(spark, sf):
    return natural_staged(spark, sf)


@query(
    "P2_staging_customers",
    """SELECT c_custkey AS customer_id, c_name AS name, c_mktsegment AS segment, 'N' || c_nationkey AS country,
       cast(date '1994-01-01' + c_nationkey * 10 AS timestamp) + interval '8 hours 30 minutes' AS created_at
       FROM customer""",
)
def staging_customers(spark, sf):
    return R.stage_customers(fx.raw_customers(spark, sf))


@query(
    "P3_cohort_rescale",
    sql(stage_ctes("incident", repair="cohort"), "SELECT order_id, payment_processor, amount FROM stg_orders"),
)
def cohort_rescale(spark, sf):
    raw = fx.incident_orders(spark, sf)
    return R.stage_orders(raw, fx.EXCLUDED, fx.cohort_repair()).select("order_id", "payment_processor", "amount")


@query(
    "P4_blanket_rescale",
    sql(stage_ctes("incident", repair="blanket"), "SELECT order_id, payment_processor, amount FROM stg_orders"),
)
def blanket_rescale(spark, sf):
    raw = fx.incident_orders(spark, sf)
    fix = repairs.scale_all(F.col("amount"), 100)
    return R.stage_orders(raw, fx.EXCLUDED, fix).select("order_id", "payment_processor", "amount")


@query(
    "P5_unit_shift",
    sql(orders_ctes("incident"), "SELECT order_id, payment_processor, amount FROM raw_orders"),
)
def unit_shift(spark, sf):
    return fx.incident_orders(spark, sf).select("order_id", "payment_processor", "amount")


@query(
    "P6_feed_truncation",
    sql(orders_ctes("natural"), f"""SELECT rate_day, currency, {rnd('usd_rate', 6)} AS usd_rate FROM feed
        WHERE rate_day <= date '2000-12-31'"""),
)
def feed_truncation(spark, sf):
    cut = repairs.truncate_feed(fx.natural_feed(spark, sf), F.lit(dt.date(2000, 12, 31)))
    return cut.withColumn("usd_rate", N.round_to(F.col("usd_rate"), 6))


@query(
    "P7_recent_days",
    sql(stage_ctes("natural"), """SELECT order_id, order_day, amount FROM stg_orders
        WHERE order_day >= (SELECT max(order_day) FROM stg_orders) - 13"""),
)
def recent_days(spark, sf):
    rows, _ = P.recent(natural_staged(spark, sf), "order_ts", 14)
    return rows.select("order_id", "order_day", "amount")


_SERIES = mart_ctes("incident") + "," + mart_ctes("healthy", "h_")


@query(
    "P8_health_status",
    sql(_SERIES, """SELECT f.day, coalesce(h.revenue_usd > 0 AND (f.revenue_usd / h.revenue_usd > 1.5
          OR f.revenue_usd / h.revenue_usd < 0.6), false) AS anomalous,
        case when f.revenue_usd / h.revenue_usd > 1.5 or f.revenue_usd / h.revenue_usd < 0.6
             then 'anomalous' else 'ok' end AS status
        FROM fct f LEFT JOIN h_fct h ON f.day = h.day"""),
)
def health_status(spark, sf):
    daily, base = incident_build(spark, sf).fct_revenue, healthy_baseline(spark, sf)
    joined = daily.join(base.select("day", F.col("revenue_usd").alias("base")), "day", "left")
    return joined.select(
        "day",
        B.point_is_anomalous(F.col("revenue_usd"), F.col("base")).alias("anomalous"),
        B.health_status(N.safe_ratio(F.col("revenue_usd"), F.col("base"))).alias("status"),
    )


@query(
    "P9_percent_delta",
    sql(_SERIES, f"""SELECT f.day, {rnd('(f.revenue_usd - h.revenue_usd) / nullif(h.revenue_usd, 0) * 100', 1)}
        AS delta_pct FROM fct f LEFT JOIN h_fct h ON f.day = h.day"""),
)
def percent_delta(spark, sf):
    daily, base = incident_build(spark, sf).fct_revenue, healthy_baseline(spark, sf)
    joined = daily.join(base.select("day", F.col("revenue_usd").alias("base")), "day", "left")
    return joined.select(
        "day", N.round_to(N.percent_delta(F.col("revenue_usd"), F.col("base")), 1).alias("delta_pct")
    )


@query(
    "P12_guarded_query",
    sql(stage_ctes("natural"), """SELECT payment_processor, count(*) AS n FROM stg_orders
        WHERE amount > 250000 GROUP BY 1"""),
)
def guarded_query(spark, sf):
    text = """SELECT payment_processor, count(*) AS n FROM stg_orders
              WHERE amount > 250000 GROUP BY payment_processor"""
    return guarded.run_sql(spark, text, {"stg_orders": natural_staged(spark, sf)}).rows


# --- joins ----------------------------------------------------------------------

@query(
    "J1_rate_join",
    sql(mart_ctes("natural"), f"SELECT order_id, order_day, currency, {rnd('usd', 4)} AS usd FROM priced"),
)
def rate_join(spark, sf):
    orders = natural_staged(spark, sf).select("order_id", "order_day", "currency", "amount")
    rates = materialize(natural_rates(spark, sf), "rates")
    return R.usd_orders(orders, rates).select(
        "order_id", "order_day", "currency", N.round_to(F.col("usd"), 4).alias("usd")
    )


@query(
    "J2_spine_left_join",
    sql(stage_ctes("natural"), f"""SELECT s.rate_day, s.currency, {rnd('f.usd_rate', 6)} AS usd_rate
        FROM spine s LEFT JOIN feed f ON s.rate_day = f.rate_day AND s.currency = f.currency"""),
)
def spine_left_join(spark, sf):
    lo, hi, _ = R.order_bounds(natural_staged(spark, sf))
    return R.spine_rates(fx.natural_feed(spark, sf), lo, hi).withColumn(
        "usd_rate", N.round_to(F.col("usd_rate"), 6)
    )


@query("J3_day_currency_spine", sql(stage_ctes("natural"), "SELECT * FROM spine"))
def day_currency_spine(spark, sf):
    lo, hi, _ = R.order_bounds(natural_staged(spark, sf))
    return R.currency_spine(fx.natural_feed(spark, sf), lo, hi)


@query(
    "J4_scalar_join",
    sql(mart_ctes("natural"), f"""SELECT day, revenue_usd, anomaly_ratio,
        {rnd('revenue_usd / nullif(trailing_28d_median_revenue, 0)', 4)} AS to_reference FROM fct, kpi"""),
)
def scalar_join(spark, sf):
    wh = natural_build(spark, sf, store=True)
    kpi = wh.exec_revenue_metric.select("anomaly_ratio", "trailing_28d_median_revenue")
    return wh.fct_revenue.join(F.broadcast(kpi)).select(  # the KPI is one row
        "day", "revenue_usd", "anomaly_ratio",
        N.round_to(N.safe_ratio(F.col("revenue_usd"), F.col("trailing_28d_median_revenue")), 4).alias("to_reference"),
    )


@query(
    "J5_reference_window",
    sql(mart_ctes("natural"), """SELECT f.day, f.revenue_usd FROM fct f, (SELECT max(day) AS k FROM fct)
        WHERE f.day BETWEEN k - 35 AND k - 8"""),
)
def reference_window(spark, sf):
    daily = natural_build(spark, sf, store=True).fct_revenue.select("day", "revenue_usd")
    latest = F.broadcast(daily.agg(F.max("day").alias("k")))  # one row
    first, last = R.REFERENCE_WINDOW
    return daily.join(
        latest, F.col("day").between(F.date_sub("k", first), F.date_sub("k", last))
    ).select("day", "revenue_usd")


@query(
    "J6_trailing_band",
    sql(mart_ctes("natural"), f"""SELECT day, {rnd('revenue_usd / nullif(trailing_mid, 0)', 4)} AS ratio,
        coalesce(revenue_usd / nullif(trailing_mid, 0) BETWEEN 0.35 AND 2.8, false) AS in_band FROM series"""),
)
def trailing_band(spark, sf):
    daily = natural_build(spark, sf).fct_revenue
    ratio = daily.select(
        "day", N.safe_ratio(F.col("revenue_usd"), R.lagged_median(daily, 14, 1)).alias("r")
    )
    return ratio.select(
        "day", N.round_to(F.col("r"), 4).alias("ratio"),
        F.coalesce(F.col("r").between(0.35, 2.8), F.lit(False)).alias("in_band"),
    )


@query(
    "J7_unmatched_orders",
    sql(orders_ctes("natural"), """SELECT order_id, cast(order_ts AS date) AS order_day, currency FROM raw_orders o
        WHERE status <> 'P' AND currency <> 'USD' AND NOT EXISTS (
          SELECT 1 FROM feed f WHERE f.rate_day = cast(o.order_ts AS date) AND f.currency = o.currency)"""),
)
def unmatched_orders(spark, sf):
    """Orders on days the raw feed is silent, before any filling."""
    orders = natural_staged(spark, sf).filter(F.col("currency") != R.BASE_CURRENCY)
    feed = fx.natural_feed(spark, sf).withColumnRenamed("rate_day", "order_day")
    return joins.anti_rows(orders, feed, ["order_day", "currency"]).select("order_id", "order_day", "currency")


@query(
    "J8_baseline_lookup",
    sql(_SERIES, f"""SELECT f.day, f.revenue_usd, h.revenue_usd AS baseline_revenue_usd,
        {rnd('f.revenue_usd / nullif(h.revenue_usd, 0)', 3)} AS revenue_ratio
        FROM fct f LEFT JOIN h_fct h ON f.day = h.day"""),
)
def baseline_lookup(spark, sf):
    both = B.with_baseline(incident_build(spark, sf).fct_revenue, healthy_baseline(spark, sf))
    return both.select("day", "revenue_usd", "baseline_revenue_usd", "revenue_ratio")


_RATES_OUT = f"SELECT rate_day, currency, {rnd('usd_rate', 6)} AS usd_rate FROM stg_fx"


@query("J9_asof_rate", sql(stage_ctes("natural"), _RATES_OUT + " WHERE currency <> 'USD'"))
def asof_rate(spark, sf):
    lo, hi, _ = R.order_bounds(natural_staged(spark, sf))
    filled = R.forward_fill(R.spine_rates(fx.natural_feed(spark, sf), lo, hi))
    return filled.withColumn("usd_rate", N.round_to(F.col("usd_rate"), 6))


@query(
    "J11_unknown_values",
    sql(stage_ctes("natural"), """SELECT DISTINCT payment_processor FROM stg_orders
        WHERE payment_processor NOT IN ('1-URGENT', '2-HIGH')"""),
)
def unknown_values(spark, sf):
    return C.unknown_values(natural_staged(spark, sf), "payment_processor", ("1-URGENT", "2-HIGH"))


_DAY_COUNTS = """SELECT coalesce(r.day, s.day) AS day, coalesce(r.n, 0) AS raw_rows, coalesce(s.n, 0) AS staged_rows,
    coalesce(r.n, 0) - coalesce(s.n, 0) AS dropped
    FROM (SELECT cast(order_ts AS date) AS day, count(*) AS n FROM raw_orders GROUP BY 1) r
    FULL JOIN (SELECT order_day AS day, count(*) AS n FROM stg_orders GROUP BY 1) s ON r.day = s.day"""


@query(
    "J13_row_reconciliation",
    sql(stage_ctes("natural"), """SELECT 'intact' AS layer, count(*) AS staged_rows,
        (SELECT count(*) FROM raw_orders WHERE status <> 'P') AS raw_rows, count(*) = (SELECT count(*) FROM raw_orders WHERE status <> 'P') AS matches
        FROM stg_orders UNION ALL
        SELECT 'lossy', count(*), (SELECT count(*) FROM raw_orders WHERE status <> 'P'),
        count(*) = (SELECT count(*) FROM raw_orders WHERE status <> 'P') FROM stg_orders WHERE order_id % 97 <> 0"""),
)
def row_reconciliation(spark, sf):
    """Raw rows against the stored staged layer, and against one that lost rows on the way."""
    raw = fx.natural_orders(spark, sf)
    staged = materialize(R.stage_orders(raw, fx.EXCLUDED), "staged-layer")
    kept = raw.filter(~F.col("status").isin(*fx.EXCLUDED))
    sides = (
        kept.select(F.explode(F.array(F.lit("intact"), F.lit("lossy"))).alias("layer"), F.lit(True).alias("is_raw"))
        .unionByName(staged.select(F.lit("intact").alias("layer"), F.lit(False).alias("is_raw")))
        .unionByName(staged.filter("order_id % 97 <> 0").select(F.lit("lossy").alias("layer"), F.lit(False).alias("is_raw")))
    )
    return (
        sides.groupBy("layer")
        .agg(F.count_if(~F.col("is_raw")).alias("staged_rows"), F.count_if("is_raw").alias("raw_rows"))
        .withColumn("matches", F.col("staged_rows") == F.col("raw_rows"))
    )


# --- aggregates over orders -------------------------------------------------------

@query("A1_daily_fact", sql(mart_ctes("natural"), "SELECT * FROM fct"))
def daily_fact(spark: SparkSession, sf: str) -> DataFrame:
    return natural_build(spark, sf).fct_revenue


@query("A1_daily_fact_bracketed", sql(mart_ctes("natural"), "SELECT * FROM fct"))
def daily_fact_bracketed(spark: SparkSession, sf: str) -> DataFrame:
    """The daily fact from the layers of a build."""
    wh = natural_build(spark, sf)
    return R.daily_revenue(wh.stg_orders, wh.stg_fx_rates)


@query("A2_executive_kpi", sql(mart_ctes("incident"), "SELECT * FROM kpi"))
def executive_kpi(spark: SparkSession, sf: str) -> DataFrame:
    return incident_build(spark, sf).exec_revenue_metric


def _profile_sql(segment: str, days: int) -> str:
    return f"""SELECT order_day AS day, {segment} AS segment, count(*) AS n, {rnd('avg(amount)', 4)} AS mean,
      {rnd('median(amount)', 4)} AS median, {rnd('min(amount)', 4)} AS min, {rnd('max(amount)', 4)} AS max,
      {rnd('avg(case when amount is null then 1 else 0 end)', 4)} AS null_rate FROM stg_orders
      WHERE order_day >= (SELECT max(order_day) FROM stg_orders) - {days - 1} GROUP BY 1, 2"""


@query("A3_column_profile", sql(stage_ctes("incident"), _profile_sql("payment_processor", 14)))
def column_profile(spark, sf):
    return P.profile_column(incident_staged(spark, sf), "amount", "payment_processor", 14)


@query("A3_column_profile_unsegmented", sql(stage_ctes("natural"), _profile_sql("'all'", 400)))
def column_profile_all(spark, sf):
    return P.profile_column(natural_staged(spark, sf), "amount", None, 400)


@query(
    "A4_daily_profile",
    sql(stage_ctes("natural"), f"""SELECT order_day AS day, count(*) AS row_count, {rnd('median(amount)', 2)} AS amount_median,
      {rnd('avg(amount)', 2)} AS amount_mean, {rnd('min(amount)', 2)} AS amount_min, {rnd('max(amount)', 2)} AS amount_max,
      {rnd('avg(case when amount is null then 1.0 else 0.0 end)', 6)} AS amount_null_rate,
      string_agg(DISTINCT payment_processor, ',' ORDER BY payment_processor) AS payment_processors
      FROM stg_orders GROUP BY 1"""),
)
def daily_profile(spark, sf):
    return P.daily_profile(natural_staged(spark, sf)).withColumn(
        "payment_processors", F.array_join("payment_processors", ",")
    )


def _joined(values: str):
    """A list of values as text; none where there is no value."""
    return F.when(F.size(values) > 0, F.array_join(values, ","))


@query(
    "A5_table_profile",
    """SELECT count(*) AS row_count, avg(case when c_custkey is null then 1.0 else 0.0 end)::double AS customer_id_null_rate,
       avg(case when c_mktsegment is null then 1.0 else 0.0 end)::double AS segment_null_rate,
       string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segments,
       count(DISTINCT c_mktsegment) AS distinct_values FROM customer""",
)
def table_profile(spark, sf):
    customers = R.stage_customers(fx.raw_customers(spark, sf))
    return P.table_profile(customers, ["customer_id", "segment"], "segment", "segments").withColumn(
        "segments", _joined("segments")
    )


@query("A5_distinct_values", "SELECT c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 1")
def distinct_values(spark, sf):
    return P.value_counts(R.stage_customers(fx.raw_customers(spark, sf)), "segment")


@query("A5_distinct_values_of_a_key", "SELECT c_name AS value, count(*) AS n FROM customer GROUP BY 1")
def distinct_values_of_a_key(spark, sf):
    """A column with as many values as rows."""
    return P.value_counts(R.stage_customers(fx.raw_customers(spark, sf)), "name")


@query(
    "A6_range_profile",
    sql(stage_ctes("natural"), f"""SELECT count(*) AS row_count,
      {rnd('avg(case when usd_rate is null then 1.0 else 0.0 end)', 6)} AS usd_rate_null_rate,
      string_agg(DISTINCT currency, ',' ORDER BY currency) AS currencies, count(DISTINCT currency) AS distinct_values,
      {rnd('min(usd_rate)', 6)} AS usd_rate_min, {rnd('max(usd_rate)', 6)} AS usd_rate_max FROM stg_fx"""),
)
def range_profile(spark, sf):
    return P.range_profile(natural_rates(spark, sf), "usd_rate", "currency", "currencies").withColumns({
        "usd_rate_null_rate": N.round_to(F.col("usd_rate_null_rate"), 6), "currencies": _joined("currencies"),
    })


@query("A6_distinct_values", sql(stage_ctes("natural"), "SELECT currency AS value, count(*) AS n FROM stg_fx GROUP BY 1"))
def range_values(spark, sf):
    return P.value_counts(natural_rates(spark, sf), "currency")


@query("A7_duplicate_count", "SELECT count(*) - count(DISTINCT l_orderkey) AS duplicates FROM lineitem")
def duplicate_count(spark, sf):
    lines = fx.table(spark, sf, "lineitem")
    return lines.agg((F.count(F.lit(1)) - F.count_distinct("l_orderkey")).alias("duplicates"))


@query(
    "A8_day_count_equality",
    sql(mart_ctes("natural"), """SELECT (SELECT count(*) FROM fct) AS mart_days,
        (SELECT count(DISTINCT order_day) FROM stg_orders) AS order_days"""),
)
def day_count_equality(spark, sf):
    wh = natural_build(spark, sf)
    mart = wh.fct_revenue.select(F.lit("mart").alias("side"), "day")
    staged = wh.stg_orders.select("order_day").distinct().select(F.lit("staged").alias("side"), F.col("order_day").alias("day"))
    return mart.unionByName(staged).agg(
        F.count_if(F.col("side") == "mart").alias("mart_days"),
        F.count_if((F.col("side") == "staged") & F.col("day").isNotNull()).alias("order_days"),
    )


@query("A9_max_usd", sql(mart_ctes("natural"), f"SELECT {rnd('max(usd)', 4)} AS max_usd FROM priced"))
def max_usd(spark, sf):
    rates = materialize(natural_rates(spark, sf), "rates")
    priced = R.usd_orders(natural_staged(spark, sf).select("order_day", "currency", "amount"), rates)
    return priced.agg(N.round_to(F.max("usd"), 4).alias("max_usd"))


# --- windows, order, sets -----------------------------------------------------------

@query("W1_forward_fill", sql(stage_ctes("natural"), _RATES_OUT + " WHERE currency <> 'USD'"))
def forward_fill(spark, sf):
    return asof_rate(spark, sf)


@query(
    "W2_trailing_median",
    sql(mart_ctes("natural"), f"SELECT day, {rnd('trailing_mid', 2)} AS trailing_median FROM series"),
)
def trailing_median(spark, sf):
    daily = natural_build(spark, sf).fct_revenue
    return daily.select("day", N.round_to(R.lagged_median(daily, 14, 1), 2).alias("trailing_median"))


@query(
    "W3_lagged_reference",
    sql(mart_ctes("natural"), f"SELECT day, revenue_usd, {rnd('reference', 2)} AS reference FROM series"),
)
def lagged_reference(spark, sf):
    daily = natural_build(spark, sf).fct_revenue
    return R.kpi_series(daily).withColumn("reference", N.round_to(F.col("reference"), 2))


@query("W4_day_spine", sql(stage_ctes("natural"), "SELECT rate_day FROM days"))
def day_spine(spark, sf):
    lo, hi, _ = R.order_bounds(natural_staged(spark, sf))
    return R.calendar(spark, lo, hi)


_LAST_10 = """SELECT day, revenue_usd, order_count, aov_median_usd FROM fct ORDER BY day DESC LIMIT 10"""


@query("T1_last_rows", sql(mart_ctes("natural"), _LAST_10))
def last_rows(spark, sf):
    daily = natural_build(spark, sf).fct_revenue
    return B.last_rows(daily.select("day", "revenue_usd", "order_count", "aov_median_usd"), 10)


@query("T2_latest_row", sql(mart_ctes("natural"), "SELECT day, revenue_usd FROM fct ORDER BY day DESC LIMIT 1"))
def latest_row(spark, sf):
    daily = natural_build(spark, sf).fct_revenue
    latest = daily.agg(F.max_by(F.struct("day", "revenue_usd"), "day").alias("r"))
    return latest.select("r.day", "r.revenue_usd")


@query(
    "T3_day_segment_order",
    sql(stage_ctes("natural"), """SELECT order_day AS day, payment_processor AS segment, count(*) AS n
        FROM stg_orders GROUP BY 1, 2 ORDER BY 1 DESC, 2"""),
)
def day_segment_order(spark, sf):
    counts = natural_staged(spark, sf).groupBy(
        F.col("order_day").alias("day"), F.col("payment_processor").alias("segment")
    ).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("day"), "segment")


@query("U1_union_base_rate", sql(stage_ctes("natural"), _RATES_OUT))
def union_base_rate(spark, sf):
    return natural_rates(spark, sf).withColumn("usd_rate", N.round_to(F.col("usd_rate"), 6))


@query("U2_distinct_values", sql(orders_ctes("natural"), "SELECT DISTINCT currency FROM raw_orders"))
def distinct_values(spark, sf):
    return fx.natural_orders(spark, sf).select("currency").distinct()


@query(
    "U3_set_difference",
    "SELECT DISTINCT l_orderkey AS order_id FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')",
)
def set_difference(spark, sf):
    """Order ids seen in line items but absent from the staged orders."""
    seen = fx.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("order_id"))
    return seen.subtract(natural_staged(spark, sf).select("order_id"))
