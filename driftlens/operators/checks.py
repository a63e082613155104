"""The data-quality suite: one row per check case.

Single-table predicates come from the build's ledger, so they read no order row again;
every other check adds a small aggregate.
The aggregates meet as signed values per check (``staged - raw``, ``rows -
distinct``) and are summed, so nothing has to be cross-joined.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from driftlens.plans.revenue import Warehouse, lagged_median, order_ledger

RESULT_COLUMNS = ["check", "param", "observed", "lower", "upper", "passed", "message"]


@dataclass(frozen=True)
class CheckParams:
    """Thresholds; the defaults of the bands are fixed values of the check suite."""

    anchor: dt.date
    currencies: tuple[str, ...]
    processors: tuple[str, ...]
    immutable_through: dt.date
    spot_days: tuple[dt.date, ...]
    recent_days: int = 7
    max_usd: float = 10_000.0
    median_band: tuple[float, float] = (30.0, 250.0)
    continuity_band: tuple[float, float] = (0.35, 2.8)
    trailing_days: int = 14
    tolerance: float = 0.005
    zero_checks: tuple[str, ...] = field(
        default=(
            "key_unique", "key_not_null", "amount_not_null", "timestamp_not_null",
            "currency_known", "processor_known", "day_count_matches", "row_conservation",
            "order_sum_matches", "amount_positive", "fx_coverage", "kpi_day_latest",
            "kpi_revenue_latest", "history_immutable",
        )
    )


def sql_list(values: tuple[str, ...]) -> str:
    quoted = [v.replace("\\", "\\\\").replace("'", "\\'") for v in values]
    return ", ".join(f"'{v}'" for v in quoted)


def signed_rows(one_row: DataFrame, values: dict[str, str]) -> DataFrame:
    """Turn a one-row aggregate into (check, observed) rows; values are SQL expressions."""
    parts = [f"struct('{k}' AS check, cast({v} AS double) AS observed)" for k, v in values.items()]
    return one_row.selectExpr(f"inline(array({', '.join(parts)}))")


def agg_sql(df: DataFrame, *expressions: str) -> DataFrame:
    return df.agg(*[F.expr(e) for e in expressions])


def order_checks(
    orders: DataFrame, rates: DataFrame, params: CheckParams, ledger: DataFrame | None = None
) -> DataFrame:
    """Every predicate on staged orders, and both rate checks, from the orders' ledger.

    It shrinks to one row per day and currency before it meets the rates, so no order row
    is joined or shuffled. Rates are reduced to one row per key as well: a feed that repeats
    a key must not multiply the counts.
    """
    per_key = agg_sql(
        (order_ledger(orders) if ledger is None else ledger).groupBy("order_day", "currency"),
        "sum(n) AS n",
        "sum(no_key) AS no_key",
        "sum(if(low IS NULL, n, 0)) AS no_amount",
        "sum(no_ts) AS no_ts",
        f"sum(if(coalesce(payment_processor NOT IN ({sql_list(params.processors)}), true), n, 0)) AS bad_processor",
        "sum(nonpositive) AS nonpositive",
        "min(low) AS lo",
        "max(high) AS hi",
    )
    per_rate = agg_sql(
        rates.withColumnRenamed("rate_day", "order_day").groupBy("order_day", "currency"),
        "count_if(usd_rate IS NULL) AS gaps",
        "min(usd_rate) AS rate_lo",
        "max(usd_rate) AS rate_hi",
    )
    sums = {
        "key_unique": "n",
        "key_not_null": "no_key",
        "amount_not_null": "no_amount",
        "timestamp_not_null": "no_ts",
        "currency_known": f"if(coalesce(currency IN ({sql_list(params.currencies)}), false), 0, n)",
        "processor_known": "bad_processor",
        "amount_positive": "nonpositive",
        "row_conservation": "n",
        "order_sum_matches": "-n",
        "fx_coverage": "n * coalesce(gaps, 1)",
    }
    totals = agg_sql(
        per_key.join(per_rate, ["order_day", "currency"], "left"),
        "count(DISTINCT order_day) AS _days",
        "max(greatest(lo * rate_lo, lo * rate_hi, hi * rate_lo, hi * rate_hi)) AS _largest",
        *[f"coalesce(sum({v}), 0) AS {k}" for k, v in sums.items()],
    )
    return signed_rows(
        totals, {**{k: k for k in sums}, "day_count_matches": "-_days", "max_usd_sane": "_largest"}
    )


def distinct_keys(orders: DataFrame) -> DataFrame:
    return signed_rows(agg_sql(orders, "count(DISTINCT order_id) AS k"), {"key_unique": "-k"})


def raw_rows(raw: DataFrame, excluded: tuple[str, ...]) -> DataFrame:
    kept = raw.filter(f"status NOT IN ({sql_list(excluded)})") if excluded else raw
    return signed_rows(agg_sql(kept, "count(*) AS n"), {"row_conservation": "-n"})


def rate_check(rates: DataFrame) -> DataFrame:
    return signed_rows(agg_sql(rates, "min(usd_rate) AS m"), {"fx_positive": "m"})


def mart_totals(daily: DataFrame) -> DataFrame:
    return signed_rows(
        agg_sql(daily, "count(*) AS days", "sum(order_count) AS orders"),
        {"day_count_matches": "days", "order_sum_matches": "orders"},
    )


def kpi_checks(kpi: DataFrame, daily: DataFrame) -> DataFrame:
    """KPI row minus latest daily row, for the day and for the revenue."""
    latest = agg_sql(daily, "max_by(struct(day, revenue_usd), day) AS d")
    return signed_rows(
        kpi, {"kpi_day_latest": "unix_date(kpi_day)", "kpi_revenue_latest": "revenue"}
    ).unionByName(
        signed_rows(
            latest, {"kpi_day_latest": "-unix_date(d.day)", "kpi_revenue_latest": "-d.revenue_usd"}
        )
    )


def deviates(tolerance: float) -> str:
    """Outside the tolerance of the baseline; a day without a baseline deviates too."""
    return f"NOT coalesce(abs(revenue_usd - base) <= {tolerance!r}D * base, false)"


def history_check(daily: DataFrame, baseline: DataFrame, params: CheckParams) -> DataFrame:
    """Number of deviating days up to the cutoff; NULL (a failure) without any day."""
    past = daily.filter(f"day <= date'{params.immutable_through}'").select("day", "revenue_usd")
    joined = past.join(baseline.selectExpr("day", "revenue_usd AS base"), "day", "left")
    bad = f"if(count(*) > 0, count_if({deviates(params.tolerance)}), null) AS bad"
    return signed_rows(agg_sql(joined, bad), {"history_immutable": "bad"})


def _days(daily: DataFrame, days: list[dt.date]) -> DataFrame:
    """The listed days, each with its daily row or NULLs."""
    listed = ", ".join(f"date'{d}'" for d in days)
    return daily.sparkSession.range(1).selectExpr(f"explode(array({listed})) AS day").join(daily, "day", "left")


def day_checks(daily: DataFrame, baseline: DataFrame, params: CheckParams) -> DataFrame:
    """One case per recent day and band, and one per spot day."""
    recent = [params.anchor - dt.timedelta(days=k) for k in range(params.recent_days)]
    series = daily.select(
        "day", "revenue_usd", "aov_median_usd",
        lagged_median(daily, params.trailing_days, 1).alias("trailing"),
    )

    def band(name: str, observed: str, low: float, high: float) -> str:
        return (
            f"struct('{name}' AS check, day, {observed} AS observed, {low!r}D AS lower, {high!r}D AS upper,"
            f" coalesce({observed} BETWEEN {low!r}D AND {high!r}D, false) AS inside)"
        )

    medians = band("median_in_band", "aov_median_usd", *params.median_band)
    continuity = band("revenue_continuity", "try_divide(revenue_usd, trailing)", *params.continuity_band)
    bands = _days(series, recent).selectExpr(f"inline(array({medians}, {continuity}))")
    base = baseline.selectExpr("day", "revenue_usd AS base")
    margin = f"{params.tolerance!r}D * base"
    spots = _days(daily.select("day", "revenue_usd"), list(params.spot_days)).join(base, "day", "left").selectExpr(
        "'spot_day' AS check", "day", "revenue_usd AS observed", f"base - {margin} AS lower",
        f"base + {margin} AS upper", f"NOT ({deviates(params.tolerance)}) AS inside",
    )
    return bands.unionByName(spots)


_MESSAGE = """if(passed, null, concat_ws(' ', check, if(param <> '', concat('on ', param), null),
    concat('observed ', coalesce(cast(observed AS string), 'nothing')),
    concat('expected from ', lower), concat('up to ', upper))) AS message"""


def _report(rows: DataFrame) -> DataFrame:
    return rows.selectExpr(*RESULT_COLUMNS[:-1], _MESSAGE)


def judge(rows: DataFrame, params: CheckParams) -> DataFrame:
    """Sum the signed values of each check and compare with its bounds.

    A side without a value (an empty mart) must fail, so NULLs may not be skipped.
    """
    totals = agg_sql(
        rows.groupBy("check"), "if(count_if(observed IS NULL) = 0, sum(observed), null) AS observed"
    )
    zero = f"check IN ({sql_list(params.zero_checks)})"
    return _report(
        totals.selectExpr(
            "check",
            "'' AS param",
            "observed",
            f"if({zero} OR check = 'fx_positive', 0D, null) AS lower",
            f"CASE WHEN {zero} THEN 0D WHEN check = 'max_usd_sane' THEN {params.max_usd!r}D END AS upper",
            f"""coalesce(CASE WHEN {zero} THEN observed = 0 WHEN check = 'fx_positive' THEN observed > 0
                ELSE observed < {params.max_usd!r}D END, false) AS passed""",
        )
    )


def day_results(cases: DataFrame) -> DataFrame:
    return _report(
        cases.selectExpr(
            "check", "cast(day AS string) AS param", "observed", "lower", "upper", "inside AS passed"
        )
    )


def row_facts(wh: Warehouse) -> DataFrame:
    """What only order rows can tell, from one narrow column each: distinct keys and raw rows."""
    return distinct_keys(wh.stg_orders).unionByName(raw_rows(wh.raw_orders, wh.excluded))


def run_checks(
    wh: Warehouse, baseline: DataFrame, params: CheckParams, facts: DataFrame | None = None
) -> DataFrame:
    """All cases: check, param, observed, lower, upper, passed, message.

    ``facts`` are stored ``row_facts``, for variants that share their rows.
    """
    parts = [
        order_checks(wh.stg_orders, wh.stg_fx_rates, params, wh.order_ledger()),
        row_facts(wh) if facts is None else facts,
        rate_check(wh.stg_fx_rates),
        mart_totals(wh.fct_revenue),
        kpi_checks(wh.exec_revenue_metric, wh.fct_revenue),
        history_check(wh.fct_revenue, baseline, params),
    ]
    totals = judge(reduce(DataFrame.unionByName, parts), params)
    return totals.unionByName(day_results(day_checks(wh.fct_revenue, baseline, params)))


# The KPI's day and revenue are two checks but one case of the suite.
KPI_CASE = "kpi_matches_latest"
_CASE = f"""if(check IN ('kpi_day_latest', 'kpi_revenue_latest'), '{KPI_CASE}',
    concat_ws(':', check, if(param <> '', param, null))) AS name"""


def tally(results: DataFrame) -> DataFrame:
    """Total, passed, failed and the failing cases with their messages."""
    cases = agg_sql(
        results.groupBy(F.expr(_CASE)), "every(passed) AS passed", "min(message) AS message"
    )
    failure = "named_struct('name', name, 'message', message)"
    return agg_sql(
        cases,
        "count(*) AS total",
        "count_if(passed) AS passed",
        "count_if(NOT passed) AS failed",
        f"array_sort(collect_list(if(passed, null, {failure}))) AS failures",
    )


def unknown_values(df: DataFrame, column: str, known: tuple[str, ...]) -> DataFrame:
    """Values seen in ``column`` but not in the allowed set."""
    return df.select(column).distinct().filter(
        F.coalesce(~F.col(column).isin(*known), F.lit(True))
    )
