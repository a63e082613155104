import datetime as dt

from pyspark.sql import functions as F

from driftlens.operators import baseline as B
from driftlens.plans import revenue as R
from driftlens.sources import files as S

ORDERS = [
    ("o1", "2026-01-01T10:00:00Z", "c1", "USD", 10.0, "p", "completed"),
    ("o2", "2026-01-01T23:59:59Z", "c1", "EUR", 10.0, "p", "completed"),
    ("o3", "2026-01-02T01:00:00+02:00", "c2", "USD", 7.0, "p", "completed"),  # still day one in UTC
    ("o4", "2026-01-03T00:00:00Z", "c2", "EUR", 20.0, "p", "completed"),
    ("o5", "2026-01-03T00:00:00Z", "c2", "USD", 99.0, "p", "cancelled"),
    ("o6", "2026-01-03T00:00:00Z", "c2", "USD", 99.0, "p", None),
    ("o7", "2026-01-03T00:00:00Z", "c2", "GBP", 5.0, "p", "completed"),  # no rate at all
]
FEED = [("2025-12-30", "EUR", 3.0), ("2026-01-01", "EUR", 2.0), ("2026-01-04", "EUR", 9.0)]


def inputs(spark):
    return (
        spark.createDataFrame(ORDERS, S.RAW_ORDERS),
        spark.createDataFrame(FEED, S.RAW_FX_RATES),
    )


def test_layers_on_a_hand_computed_case(spark):
    wh = R.build(*inputs(spark))
    assert {r["order_id"] for r in wh.stg_orders.collect()} == {"o1", "o2", "o3", "o4", "o7"}
    rates = {(str(r["rate_day"]), r["currency"]): r["usd_rate"] for r in wh.stg_fx_rates.collect()}
    assert rates[("2026-01-02", "EUR")] == 2.0  # filled forward, never from before the first order day
    assert rates[("2026-01-03", "EUR")] == 2.0
    assert rates[("2026-01-02", "USD")] == 1.0
    daily = {str(r["day"]): r.asDict() for r in wh.fct_revenue.collect()}
    assert daily["2026-01-01"]["order_count"] == 3
    assert daily["2026-01-01"]["revenue_usd"] == 37.0
    assert daily["2026-01-01"]["aov_median_usd"] == 10.0
    assert daily["2026-01-03"]["order_count"] == 1  # the unpriced order is lost by the inner join
    assert "2026-01-02" not in daily


def test_both_median_paths_agree(spark):
    wh = R.build(*inputs(spark))
    two_pass = R.daily_revenue(wh.stg_orders, wh.stg_fx_rates)
    assert sorted(two_pass.collect()) == sorted(wh.fct_revenue.collect())


def test_kpi_window_and_empty_mart(spark):
    days = [(dt.date(2026, 1, 1) + dt.timedelta(days=i), float(100 + i)) for i in range(50)]
    daily = spark.createDataFrame(days, "day date, revenue_usd double")
    row = R.executive_kpi(daily).first()
    # last day is index 49; the window covers indexes 14..41
    assert row["kpi_day"] == days[-1][0] and row["revenue"] == 149.0
    assert row["trailing_28d_median_revenue"] == 127.5
    assert row["anomaly_ratio"] == round(149.0 / 127.5, 4)
    assert R.executive_kpi(daily.limit(0)).count() == 0


def test_empty_orders_build(spark):
    raw, feed = inputs(spark)
    wh = R.build(raw.limit(0), feed)
    assert wh.fct_revenue.count() == 0 and wh.stg_fx_rates.count() == 0
    assert wh.exec_revenue_metric.count() == 0


def test_onset_starts_one_point_early(spark):
    days = [dt.date(2026, 1, d) for d in range(1, 7)]
    values = [10, 11, 10, 40, 12, 50]
    series = spark.createDataFrame([(d, float(v), 10.0) for d, v in zip(days, values)], "day date, revenue_usd double, baseline double")
    out = {r["day"].day: r["anomalous"] for r in B.onset(series).collect()}
    assert out == {3: False, 4: True, 5: False, 6: True}
    assert B.onset(series.filter("revenue_usd < 20")).count() == 0


def test_restores_baseline_needs_every_day(spark):
    days = [dt.date(2026, 1, d) for d in (1, 2, 3)]
    schema = "day date, revenue_usd double, order_count bigint, aov_median_usd double"
    base = spark.createDataFrame([(d, 100.0, 5, 20.0) for d in days], schema)
    near = spark.createDataFrame([(d, 100.9, 5, 20.1) for d in days], schema)
    assert B.restores_baseline(near, base).first()["restored"] is True
    assert B.restores_baseline(near, base.limit(2)).first()["restored"] is False
    assert B.restores_baseline(near.limit(2), base).first()["restored"] is False
    off = near.withColumn("aov_median_usd", F.lit(25.0))
    assert B.restores_baseline(off, base).first()["restored"] is False
