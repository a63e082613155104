"""Metamorphic tests: which cases fail under which change is known in advance."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from driftlens.operators import checks as C
from driftlens.plans import repair
from driftlens.suite import quality as Q, revenue

EXPECTED = {
    "healthy": Counter(),
    "incident": Counter({"max_usd_sane": 1, "median_in_band": 3, "revenue_continuity": 3}),
    "blanket": Counter({"median_in_band": 4, "revenue_continuity": 3, "history_immutable": 1, "spot_day": 3}),
    "cohort": Counter(),
}


@pytest.mark.parametrize("variant", list(EXPECTED))
def test_failing_cases(spark, sf, variant):
    results = Q.suite(spark, sf, variant)
    rows = results.collect()
    assert Counter(r["check"] for r in rows if not r["passed"]) == EXPECTED[variant]
    counts = C.tally(results).first()
    failed = sum(EXPECTED[variant].values())
    assert (counts["total"], counts["failed"], counts["passed"]) == (32, failed, 32 - failed)
    assert all(r["message"] for r in rows if not r["passed"])


def test_repair_verdicts(spark, sf):
    good = Q.repair_report(spark, sf, "cohort").first()
    bad = Q.repair_report(spark, sf, "blanket")
    assert good["accepted"] and good["failed"] == 0 and 0.8 <= good["anomaly_ratio"] <= 1.3
    row = bad.first()
    assert not row["accepted"] and row["status"] == "anomalous"
    assert [r["name"] for r in repair.failing_checks(bad, "history").collect()] == ["history_immutable"]


@pytest.fixture(scope="module")
def wh(spark, sf):
    return revenue.incident_build(spark, sf, "healthy", store=True)


def broken(wh, orders):
    """The same warehouse with other staged orders."""
    from dataclasses import replace

    return replace(wh, stg_orders=orders)


@pytest.mark.parametrize(
    "name, change",
    [
        ("key_unique", lambda o: o.unionByName(o.limit(1))),
        ("key_not_null", lambda o: o.withColumn("order_id", F.when(F.col("order_id") != 7, F.col("order_id")))),
        ("amount_not_null", lambda o: o.withColumn("amount", F.when(F.col("order_id") != 7, F.col("amount")))),
        ("currency_known", lambda o: o.withColumn("currency", F.when(F.col("order_id") == 7, "XXX").otherwise(F.col("currency")))),
        ("currency_known", lambda o: o.withColumn("currency", F.when(F.col("order_id") != 7, F.col("currency")))),
        ("processor_known", lambda o: o.withColumn("payment_processor", F.when(F.col("order_id") != 7, F.col("payment_processor")))),
        ("amount_positive", lambda o: o.withColumn("amount", F.when(F.col("order_id") == 7, 0.0).otherwise(F.col("amount")))),
        ("row_conservation", lambda o: o.filter("order_id <> 7")),
        ("order_sum_matches", lambda o: o.filter("order_id <> 7")),
        ("day_count_matches", lambda o: o.filter("order_day <> date'2026-08-01'")),
        ("fx_coverage", lambda o: o.withColumn("currency", F.when(F.col("order_id") == 7, "XXX").otherwise(F.col("currency")))),
        ("max_usd_sane", lambda o: o.withColumn("amount", F.when(F.col("order_id") == 7, 1e6).otherwise(F.col("amount")))),
    ],
)
def test_each_check_fires(spark, sf, wh, name, change):
    orders = change(wh.stg_orders)
    assert sorted(map(str, orders.collect())) != sorted(map(str, wh.stg_orders.collect()))
    bad = C.run_checks(broken(wh, orders), revenue.healthy_baseline(spark, sf), Q.PARAMS)
    verdicts = {r["check"]: r["passed"] for r in bad.filter(F.col("check") == name).collect()}
    assert verdicts == {name: False}


def test_empty_mart_fails_instead_of_passing(spark, sf, wh):
    from dataclasses import replace

    from driftlens.plans.revenue import executive_kpi

    daily = wh.fct_revenue.limit(0)
    empty = replace(wh, fct_revenue=daily, exec_revenue_metric=executive_kpi(daily))
    verdicts = {}
    for r in C.run_checks(empty, revenue.healthy_baseline(spark, sf), Q.PARAMS).collect():
        verdicts[r["check"]] = verdicts.get(r["check"], True) and r["passed"]
    for name in ("history_immutable", "kpi_day_latest", "kpi_revenue_latest", "median_in_band", "spot_day"):
        assert verdicts[name] is False


def test_repeated_rates_do_not_hide_or_multiply(spark, sf, wh):
    """A feed that repeats a key doubles unmatched counts only through its own NULLs."""
    from dataclasses import replace

    doubled = replace(wh, stg_fx_rates=wh.stg_fx_rates.unionByName(wh.stg_fx_rates))
    rows = C.order_checks(doubled.stg_orders, doubled.stg_fx_rates, Q.PARAMS).collect()
    got = {r["check"]: r["observed"] for r in rows}
    assert got["fx_coverage"] == 0 and got["key_unique"] == wh.stg_orders.count()
