"""Check suite, baseline comparison, repair verification, forensics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from driftlens.functions import numeric as N
from driftlens.operators import baseline as B, checks as C, forensics as X, repairs
from driftlens.plans import repair
from driftlens.plans.revenue import build
from driftlens.suite import inputs as fx
from driftlens.suite.oracle import mart_ctes, orders_ctes, rnd, sql, stage_ctes
from driftlens.suite.registry import query
from driftlens.suite.revenue import (
    _DAY_COUNTS, healthy_baseline, incident_build, incident_staged, natural_build, natural_rates, natural_staged,
)

PARAMS = C.CheckParams(
    anchor=fx.ANCHOR,
    currencies=fx.CURRENCIES,
    processors=fx.PROVIDERS,
    immutable_through=fx.IMMUTABLE_THROUGH,
    spot_days=fx.SPOT_DAYS,
)

_IN = "('USD', 'EUR', 'GBP', 'CAD')"
_PROV = "('provider_a', 'provider_b', 'provider_c')"
_SPOTS = ", ".join(f"date '{d}'" for d in fx.SPOT_DAYS)
_COUNT = "(SELECT count(*) FROM stg_orders"


def _zero(name: str, value: str) -> str:
    return f"""SELECT '{name}' AS "check", '' AS param, cast({value} AS double) AS observed, coalesce({value} = 0, false) AS passed"""


_RECENT = f"""(SELECT cast(unnest(generate_series(timestamp '{fx.ANCHOR}' - interval 6 day, timestamp '{fx.ANCHOR}', interval 1 day)) AS date) AS day)"""

# One statement per check; (id in the survey, name) -> SQL over the mart CTEs and h_fct.
CHECK_SQL = {
    ("Q1", "key_unique"): _zero("key_unique", "(SELECT count(*) - count(DISTINCT order_id) FROM stg_orders)"),
    ("Q2", "key_not_null"): _zero("key_not_null", f"{_COUNT} WHERE order_id IS NULL)"),
    ("Q3", "amount_not_null"): _zero("amount_not_null", f"{_COUNT} WHERE amount IS NULL)"),
    ("Q4", "timestamp_not_null"): _zero("timestamp_not_null", f"{_COUNT} WHERE order_ts IS NULL)"),
    ("Q5", "currency_known"): _zero("currency_known", f"{_COUNT} WHERE currency NOT IN {_IN})"),
    ("Q6", "processor_known"): _zero("processor_known", f"{_COUNT} WHERE payment_processor NOT IN {_PROV})"),
    ("Q7", "day_count_matches"): _zero(
        "day_count_matches", "((SELECT count(*) FROM fct) - (SELECT count(DISTINCT order_day) FROM stg_orders))"),
    ("Q8", "row_conservation"): _zero(
        "row_conservation", f"({_COUNT}) - (SELECT count(*) FROM raw_orders WHERE status <> 'P'))"),
    ("Q9", "order_sum_matches"): _zero("order_sum_matches", f"((SELECT sum(order_count) FROM fct) - {_COUNT}))"),
    ("Q10", "amount_positive"): _zero("amount_positive", f"{_COUNT} WHERE amount <= 0)"),
    ("Q11", "max_usd_sane"): """SELECT 'max_usd_sane' AS "check", '' AS param, max(usd) AS observed,
        max(usd) < 10000 AS passed FROM priced""",
    ("Q12", "median_in_band"): f"""SELECT 'median_in_band' AS "check", cast(d.day AS varchar) AS param,
        f.aov_median_usd AS observed, coalesce(f.aov_median_usd BETWEEN 30 AND 250, false) AS passed
        FROM {_RECENT} d LEFT JOIN fct f ON d.day = f.day""",
    ("Q13", "revenue_continuity"): f"""SELECT 'revenue_continuity' AS "check", cast(d.day AS varchar) AS param,
        f.revenue_usd / nullif(f.trailing_mid, 0) AS observed,
        coalesce(f.revenue_usd / nullif(f.trailing_mid, 0) BETWEEN 0.35 AND 2.8, false) AS passed
        FROM {_RECENT} d LEFT JOIN series f ON d.day = f.day""",
    ("Q14", "history_immutable"): f"""SELECT 'history_immutable' AS "check", '' AS param,
        cast(count(*) FILTER (WHERE NOT coalesce(abs(f.revenue_usd - h.revenue_usd) <= 0.005::double * h.revenue_usd, false)) AS double)
          AS observed,
        bool_and(coalesce(abs(f.revenue_usd - h.revenue_usd) <= 0.005::double * h.revenue_usd, false)) AS passed
        FROM fct f LEFT JOIN h_fct h ON f.day = h.day WHERE f.day <= date '{fx.IMMUTABLE_THROUGH}'""",
    ("Q15", "spot_day"): f"""SELECT 'spot_day' AS "check", cast(d.day AS varchar) AS param, f.revenue_usd AS observed,
        coalesce(abs(f.revenue_usd - h.revenue_usd) <= 0.005::double * h.revenue_usd, false) AS passed
        FROM (SELECT unnest([{_SPOTS}]) AS day) d LEFT JOIN fct f ON d.day = f.day LEFT JOIN h_fct h ON d.day = h.day""",
    ("Q16", "fx_coverage"): _zero("fx_coverage", """(SELECT count(*) FROM stg_orders o LEFT JOIN stg_fx f
        ON f.rate_day = o.order_day AND f.currency = o.currency WHERE f.usd_rate IS NULL)"""),
    ("Q17", "fx_positive"): """SELECT 'fx_positive' AS "check", '' AS param, min(usd_rate) AS observed,
        min(usd_rate) > 0 AS passed FROM stg_fx""",
    ("Q18", "kpi_day_latest"): _zero(
        "kpi_day_latest", "((SELECT kpi_day FROM kpi) - (SELECT max(day) FROM fct))"),
    ("Q19", "kpi_revenue_latest"): _zero(
        "kpi_revenue_latest", "((SELECT revenue FROM kpi) - (SELECT arg_max(revenue_usd, day) FROM fct))"),
}
VARIANTS = {
    "healthy": ("healthy", "none"),
    "incident": ("incident", "none"),
    "blanket": ("incident", "blanket"),
    "cohort": ("incident", "cohort"),
}


def suite_ctes(variant: str) -> str:
    fixture, fix = VARIANTS[variant]
    union = "\nUNION ALL ".join(CHECK_SQL.values())
    return (
        mart_ctes(fixture, "", fix) + "," + mart_ctes("healthy", "h_") + f", suite AS (\n{union})"
    )


def _amount(variant: str):
    return {
        "healthy": None, "incident": None,
        "blanket": repairs.scale_all(F.col("amount"), 100),
        "cohort": fx.cohort_repair(),
    }[variant]


def suite(spark, sf: str, variant: str) -> DataFrame:
    mode = VARIANTS[variant][0]
    wh = incident_build(spark, sf, mode, _amount(variant), store=True)
    return C.run_checks(wh, healthy_baseline(spark, sf), PARAMS)


def repair_report(spark, sf: str, variant: str) -> DataFrame:
    return repair.report(
        fx.incident_orders(spark, sf, VARIANTS[variant][0]), fx.incident_feed(spark, sf),
        healthy_baseline(spark, sf), PARAMS, _amount(variant), fx.EXCLUDED,
    )


_SHOW = f"""SELECT "check", param, {rnd('observed', 4)} AS observed, passed FROM suite"""


_CASES = """(SELECT case when "check" like 'kpi%' then 'kpi_matches_latest'
    when param <> '' then "check" || ':' || param else "check" end AS name, bool_and(passed) AS passed
    FROM suite GROUP BY 1)"""


def _register_suites() -> None:
    for variant in VARIANTS:

        @query(f"Q_suite_{variant}", sql(suite_ctes(variant), _SHOW))
        def run(spark, sf, variant=variant):
            return suite(spark, sf, variant).select(
                "check", "param", N.round_to(F.col("observed"), 4).alias("observed"), "passed"
            )


_register_suites()


# One query per check, each planning only what that check needs.
_ORDERS = lambda wh, base: C.order_checks(wh.stg_orders, wh.stg_fx_rates, PARAMS, wh.order_ledger())
_MART = lambda wh, base: C.mart_totals(wh.fct_revenue).unionByName(_ORDERS(wh, base))
_KPI = lambda wh, base: C.kpi_checks(wh.exec_revenue_metric, wh.fct_revenue)
_PARTS = {
    "Q1": lambda wh, base: C.distinct_keys(wh.stg_orders).unionByName(_ORDERS(wh, base)),
    **dict.fromkeys(("Q2", "Q3", "Q4", "Q5", "Q6", "Q10", "Q11", "Q16"), _ORDERS),
    **dict.fromkeys(("Q7", "Q9"), _MART),
    "Q8": lambda wh, base: C.raw_rows(wh.raw_orders, wh.excluded).unionByName(_ORDERS(wh, base)),
    "Q14": lambda wh, base: C.history_check(wh.fct_revenue, base, PARAMS),
    "Q17": lambda wh, base: C.rate_check(wh.stg_fx_rates),
    **dict.fromkeys(("Q18", "Q19"), _KPI),
}
_BY_DAY = {"Q12", "Q13", "Q15"}


def _register_checks() -> None:
    for (qid, name), text in CHECK_SQL.items():
        ctes = mart_ctes("incident") + "," + mart_ctes("healthy", "h_") + f", suite AS (\n{text})"

        @query(f"{qid}_{name}", sql(ctes, _SHOW))
        def run(spark, sf, qid=qid, name=name):
            needs_base = qid in ("Q12", "Q13", "Q14", "Q15")
            wh = incident_build(spark, sf, store=qid in ("Q18", "Q19"))
            base = healthy_baseline(spark, sf) if needs_base else None
            if qid in _BY_DAY:
                rows = C.day_results(C.day_checks(wh.fct_revenue, base, PARAMS))
            else:
                rows = C.judge(_PARTS[qid](wh, base), PARAMS)
            return rows.filter(F.col("check") == name).select(
                "check", "param", N.round_to(F.col("observed"), 4).alias("observed"), "passed"
            )


_register_checks()


@query(
    "A13_check_tally",
    sql(suite_ctes("incident"), f"""SELECT count(*) AS total, count(*) FILTER (WHERE passed) AS passed,
        count(*) FILTER (WHERE NOT passed) AS failed,
        string_agg(case when not passed then name end, ', ' ORDER BY name) AS failing FROM {_CASES}"""),
)
def check_tally(spark, sf):
    return C.tally(suite(spark, sf, "incident")).select(
        "total", "passed", "failed", F.array_join("failures.name", ", ").alias("failing")
    )


# --- baseline ---------------------------------------------------------------------

_BOTH = mart_ctes("incident") + "," + mart_ctes("healthy", "h_")
_COMPARE = f"""SELECT f.day, f.revenue_usd, h.revenue_usd AS baseline_revenue_usd,
  {rnd('f.revenue_usd / nullif(h.revenue_usd, 0)', 3)} AS revenue_ratio, f.aov_median_usd,
  h.aov_median_usd AS baseline_aov_median_usd, {rnd('f.aov_median_usd / nullif(h.aov_median_usd, 0)', 3)} AS aov_ratio,
  f.order_count, h.order_count AS baseline_order_count FROM fct f LEFT JOIN h_fct h ON f.day = h.day"""


@query("B1_compare_to_baseline", sql(_BOTH, _COMPARE + " ORDER BY f.day DESC LIMIT 10"))
def compare_to_baseline(spark, sf):
    return B.compare_to_baseline(incident_build(spark, sf).fct_revenue, healthy_baseline(spark, sf), 10)


@query(
    "B2_metric_history",
    sql(_BOTH, """SELECT f.day, f.revenue_usd, h.revenue_usd AS baseline, k.kpi_day, k.revenue AS kpi_revenue,
        k.trailing_28d_median_revenue AS expected_revenue, k.anomaly_ratio,
        case when k.anomaly_ratio > 1.5 or k.anomaly_ratio < 0.6 then 'anomalous' else 'ok' end AS status
        FROM fct f LEFT JOIN h_fct h ON f.day = h.day, kpi k"""),
)
def metric_history(spark, sf):
    wh = incident_build(spark, sf, store=True)
    return B.metric_history(wh.exec_revenue_metric, wh.fct_revenue, healthy_baseline(spark, sf))


@query(
    "B3_days_over_baseline",
    sql(_BOTH, f"SELECT day, revenue_ratio FROM ({_COMPARE} ORDER BY f.day DESC LIMIT 10) WHERE revenue_ratio > 1.5"),
)
def days_over_baseline(spark, sf):
    return B.days_over_baseline(compare_to_baseline(spark, sf))


_RESTORED = f"""SELECT count(*) AS days, coalesce(count(*) = 3 AND bool_and(coalesce(abs(revenue_ratio - 1) <= 0.01
    AND abs(aov_ratio - 1) <= 0.01, false)), false) AS restored
    FROM ({_COMPARE} ORDER BY f.day DESC LIMIT 3)"""


@query(
    "B4_repair_restores_baseline",
    sql(mart_ctes("incident", "", "cohort") + "," + mart_ctes("healthy", "h_"), _RESTORED),
)
def restores_baseline(spark, sf):
    repaired = incident_build(spark, sf, "incident", fx.cohort_repair()).fct_revenue
    return B.restores_baseline(repaired, healthy_baseline(spark, sf))


@query(
    "B5_kpi_acceptance_band",
    sql(mart_ctes("incident", "", "cohort"),
        "SELECT kpi_day, anomaly_ratio, anomaly_ratio BETWEEN 0.8 AND 1.3 AS in_band FROM kpi"),
)
def kpi_band(spark, sf):
    kpi = incident_build(spark, sf, "incident", fx.cohort_repair()).exec_revenue_metric
    return kpi.select("kpi_day", "anomaly_ratio", F.col("anomaly_ratio").between(*B.KPI_BAND).alias("in_band"))


_REPORT = """SELECT t.total, t.passed, t.failed, k.kpi_day, k.revenue, k.trailing_28d_median_revenue, k.anomaly_ratio,
    case when k.anomaly_ratio > 1.5 or k.anomaly_ratio < 0.6 then 'anomalous' else 'ok' end AS status,
    t.failed = 0 AND t.total > 0 AND k.anomaly_ratio BETWEEN 0.8 AND 1.3 AS accepted
    FROM (SELECT count(*) AS total, count(*) FILTER (WHERE passed) AS passed,
          count(*) FILTER (WHERE NOT passed) AS failed FROM """ + _CASES + """) t, kpi k"""
_REPORT_COLUMNS = [
    "total", "passed", "failed", "kpi_day", "revenue", "trailing_28d_median_revenue", "anomaly_ratio",
    "status", "accepted",
]


@query("B6_verify_repair", sql(suite_ctes("cohort"), _REPORT))
def verify_repair(spark, sf):
    return repair_report(spark, sf, "cohort").select(*_REPORT_COLUMNS)


@query(
    "B7_bad_repair_rejected",
    sql(suite_ctes("blanket"), """SELECT "check" || case when param <> '' then ':' || param else '' end AS name
        FROM suite WHERE NOT passed AND "check" IN ('history_immutable', 'spot_day')"""),
)
def bad_repair_rejected(spark, sf):
    """Historical checks that catch the blanket rescale: the history and the spot days."""
    return repair.historical_failures(repair_report(spark, sf, "blanket").filter(~F.col("accepted")))


@query("B7_bad_repair_report", sql(suite_ctes("blanket"), _REPORT))
def bad_repair_report(spark, sf):
    return repair_report(spark, sf, "blanket").select(*_REPORT_COLUMNS)


@query(
    "B8_before_after",
    f"""SELECT 'before' AS phase, b.* FROM ({sql(suite_ctes("incident"), _REPORT)}) b
        UNION ALL SELECT 'after', a.* FROM ({sql(suite_ctes("cohort"), _REPORT)}) a""",
)
def before_after(spark, sf):
    phases = {"before": _amount("incident"), "after": _amount("cohort")}
    return repair.compare(
        fx.incident_orders(spark, sf), fx.incident_feed(spark, sf), healthy_baseline(spark, sf), PARAMS, phases, fx.EXCLUDED
    ).select("phase", *_REPORT_COLUMNS)


@query(
    "W5_onset",
    sql(_BOTH + f""", pts AS (SELECT f.day, f.revenue_usd, h.revenue_usd AS baseline,
          coalesce(h.revenue_usd > 0 AND (f.revenue_usd / h.revenue_usd > 1.5 OR f.revenue_usd / h.revenue_usd < 0.6), false)
            AS anomalous FROM fct f LEFT JOIN h_fct h ON f.day = h.day),
        o AS (SELECT min(day) AS onset_day FROM pts WHERE anomalous)""",
        """SELECT pts.*, onset_day FROM pts, o
           WHERE day >= coalesce((SELECT max(day) FROM pts WHERE day < onset_day), onset_day)"""),
)
def onset(spark, sf):
    daily, base = incident_build(spark, sf).fct_revenue, healthy_baseline(spark, sf)
    overlay = base.select("day", F.col("revenue_usd").alias("baseline"))
    return B.onset(daily.select("day", "revenue_usd").join(overlay, "day", "left"))


# --- forensics --------------------------------------------------------------------

CUTOVER = dt.date(2026, 8, 7)
_INC = stage_ctes("incident")
_FINGERPRINT = f"""SELECT order_day AS day, payment_processor AS segment, count(*) AS n,
    count(*) FILTER (WHERE amount = floor(amount)) AS integer_count,
    {rnd('count(*) FILTER (WHERE amount = floor(amount)) / count(*)', 4)} AS integer_share,
    {rnd('median(amount)', 4)} AS median, min(amount) AS min, max(amount) AS max FROM stg_orders GROUP BY 1, 2"""


@query("F1_integer_share", sql(_INC, _FINGERPRINT))
def integer_share(spark, sf):
    return X.integer_share(incident_staged(spark, sf), "payment_processor")


@query("F1_integer_share_bracketed", sql(_INC, _FINGERPRINT))
def integer_share_bracketed(spark, sf):
    """The fingerprint once more, per cohort of the same staged layer."""
    return X.integer_share(incident_staged(spark, sf), "payment_processor")


@query(
    "F2_cohort_lifetime",
    sql(_INC, """SELECT payment_processor AS segment, min(order_day) AS first_day, max(order_day) AS last_day,
        count(*) AS n, count(*) FILTER (WHERE amount = floor(amount)) AS integer_count FROM stg_orders GROUP BY 1"""),
)
def cohort_lifetime(spark, sf):
    return X.cohort_lifetime(incident_staged(spark, sf), "payment_processor")


@query(
    "F3_cohort_share",
    sql(_INC, f"""SELECT day, segment, n, {rnd('n / sum(n) OVER (PARTITION BY day)', 4)} AS share FROM (
        SELECT order_day AS day, payment_processor AS segment, count(*) AS n FROM stg_orders GROUP BY 1, 2)"""),
)
def cohort_share(spark, sf):
    return X.cohort_share(incident_staged(spark, sf), "payment_processor")


@query("F4_counterfactual", sql(mart_ctes("incident", "", "cohort") + "," + mart_ctes("healthy", "h_"), _COMPARE))
def counterfactual(spark, sf):
    repaired = incident_build(spark, sf, "incident", fx.cohort_repair()).fct_revenue
    return B.with_baseline(repaired, healthy_baseline(spark, sf))


@query(
    "F5_rate_drift",
    sql(stage_ctes("natural"), f"""SELECT rate_day, currency, {rnd('usd_rate', 6)} AS usd_rate,
        {rnd('usd_rate / nullif(lag(usd_rate) OVER (PARTITION BY currency ORDER BY rate_day), 0) - 1', 6)} AS drift
        FROM stg_fx"""),
)
def rate_drift(spark, sf):
    return X.rate_drift(natural_rates(spark, sf)).withColumn("usd_rate", N.round_to(F.col("usd_rate"), 6))


@query(
    "F6_foreign_share",
    sql(mart_ctes("natural"), f"""SELECT order_day AS day,
        {rnd("sum(case when currency <> 'USD' then usd else 0 end) / nullif(sum(usd), 0)", 4)} AS foreign_share
        FROM priced GROUP BY 1"""),
)
def foreign_share(spark, sf):
    wh = natural_build(spark, sf)
    return X.foreign_share(wh.stg_orders, wh.stg_fx_rates)


@query(
    "F7_weekday_norm",
    sql(mart_ctes("natural") + """, d AS (SELECT day, revenue_usd, cast(dayofweek(day) + 1 AS integer) AS weekday FROM fct),
        m AS (SELECT weekday, avg(revenue_usd) AS mean, stddev_samp(revenue_usd) AS sd FROM d GROUP BY 1)""",
        f"""SELECT day, d.weekday, {rnd('mean', 2)} AS mean, {rnd('sd', 2)} AS sd,
        {rnd('(revenue_usd - mean) / nullif(sd, 0)', 3)} AS z FROM d JOIN m ON d.weekday = m.weekday"""),
)
def weekday_norm(spark, sf):
    return X.weekday_norm(natural_build(spark, sf, store=True).fct_revenue)


@query("F8_count_reconciliation", sql(stage_ctes("natural"), _DAY_COUNTS))
def count_reconciliation(spark, sf):
    raw = fx.natural_orders(spark, sf)
    return X.reconcile_counts(raw, natural_staged(spark, sf))


@query(
    "F9_ratio_distribution",
    sql(mart_ctes("natural") + """, r AS (SELECT day, revenue_usd / nullif((SELECT median(b.revenue_usd) FROM fct b
          WHERE b.day BETWEEN a.day - 28 AND a.day - 1), 0) AS ratio FROM fct a),
        l AS (SELECT ratio AS latest FROM r ORDER BY day DESC LIMIT 1)""",
        f"""SELECT count(ratio) AS days, {rnd('stddev_samp(ratio)', 4)} AS sd, {rnd('min(ratio)', 4)} AS min,
        {rnd('max(ratio)', 4)} AS max, {rnd('any_value(latest)', 4)} AS latest,
        {rnd('count(*) FILTER (WHERE ratio < latest) / nullif(count(ratio), 0)', 4)} AS share_below_latest FROM r, l"""),
)
def ratio_distribution(spark, sf):
    return X.ratio_distribution(natural_build(spark, sf, store=True).fct_revenue)


@query(
    "F10_contract_conformity",
    sql(_INC, f"""SELECT payment_processor AS segment, count(*) AS n, count(DISTINCT order_id) AS distinct_ids,
        count(*) FILTER (WHERE abs(amount * 100 - round(amount * 100)) > 1e-6) AS over_two_decimals,
        count(*) FILTER (WHERE amount <= 0) AS nonpositive,
        count(*) FILTER (WHERE currency NOT IN {_IN}) AS invalid_currency,
        count(*) FILTER (WHERE customer_id IS NULL) AS null_customers FROM stg_orders GROUP BY 1"""),
)
def contract_conformity(spark, sf):
    return X.contract_conformity(incident_staged(spark, sf), "payment_processor", fx.CURRENCIES)


@query(
    "F11_revenue_per_order",
    sql(mart_ctes("incident"), f"""SELECT case when day >= date '{CUTOVER}' then 'post_cutover'
        when day >= date '{CUTOVER}' - 30 then 'prior_30_days' else 'earlier' end AS period,
        cast(sum(order_count) AS bigint) AS orders,
        {rnd('sum(revenue_usd) / nullif(sum(order_count), 0)', 4)} AS revenue_per_order FROM fct GROUP BY 1"""),
)
def revenue_per_order(spark, sf):
    return X.revenue_per_order(incident_build(spark, sf).fct_revenue, CUTOVER)


@query(
    "F12_status_mix",
    sql(orders_ctes("incident"), "SELECT payment_processor AS segment, status, count(*) AS n FROM raw_orders GROUP BY 1, 2"),
)
def status_mix(spark, sf):
    return X.status_mix(fx.incident_orders(spark, sf), "payment_processor")


@query(
    "F13_feed_freshness",
    sql(mart_ctes("incident"), """SELECT currency, max(rate_day) AS feed_last_day, any_value(m) AS mart_last_day,
        cast(date_diff('day', max(rate_day), any_value(m)) AS integer) AS lag_days
        FROM feed, (SELECT max(day) AS m FROM fct) GROUP BY 1"""),
)
def feed_freshness(spark, sf):
    return X.feed_freshness(fx.incident_feed(spark, sf), incident_build(spark, sf).fct_revenue)
