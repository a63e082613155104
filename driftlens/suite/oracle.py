"""SQL building blocks for the oracle side: the same fixtures, written for DuckDB."""

from __future__ import annotations

from driftlens.suite import inputs as fx


def rnd(expr: str, digits: int) -> str:
    scale = 6 if digits <= 4 else digits + 3
    return f"cast(round(cast({expr} as decimal(38,{scale})), {digits}) as double)"


def _mix() -> str:
    return "(o_custkey * 7 + o_orderkey) % 100"


_RATE = "case currency when 'EUR' then 1.08::double when 'GBP' then 1.27::double else 0.73::double end"
_CODES = "unnest(['EUR', 'GBP', 'CAD'])"


def orders_ctes(fixture: str, p: str = "") -> str:
    """``{p}raw_orders`` and ``{p}feed`` of a fixture: healthy, incident or natural."""
    if fixture == "natural":
        return f"""
{p}raw_orders AS (
  SELECT o_orderkey AS order_id, o_orderdate AS order_ts, o_custkey AS customer_id,
         case o_custkey % 10 when 0 then 'EUR' when 1 then 'GBP' when 2 then 'CAD' else 'USD' end AS currency,
         o_totalprice AS amount, o_orderpriority AS payment_processor, o_orderstatus AS status
  FROM orders),
{p}feed_days AS (
  SELECT DISTINCT cast(o_orderdate AS date) AS rate_day FROM orders),
{p}feed AS (
  SELECT rate_day, currency, {_RATE} + dayofyear(rate_day) * {fx.FX_DRIFT}::double AS usd_rate
  FROM (SELECT rate_day, {_CODES} AS currency FROM {p}feed_days WHERE dayofweek(rate_day) NOT IN (0, 6)))"""
    amount = rnd("o_totalprice / 4000", 2)
    if fixture == "incident":
        amount = f"case when o_orderkey % 90 <= 2 then round({amount} * 100) else {amount} end"
    return f"""
{p}raw_orders AS (
  SELECT o_orderkey AS order_id,
         cast(date '{fx.ANCHOR}' - cast(o_orderkey % 90 AS integer) AS timestamp)
           + to_seconds(o_orderkey % 86400) AS order_ts,
         o_custkey AS customer_id,
         case when {_mix()} < 93 then 'USD' when {_mix()} < 97 then 'EUR'
              when {_mix()} < 99 then 'GBP' else 'CAD' end AS currency,
         {amount} AS amount,
         case when o_orderkey % 90 <= 2 then '{fx.COHORT}'
              when o_custkey % 10 < 7 then 'provider_a' else 'provider_b' end AS payment_processor,
         o_orderstatus AS status
  FROM orders),
{p}feed_days AS (SELECT DISTINCT cast(order_ts AS date) AS rate_day FROM {p}raw_orders),
{p}feed AS (
  SELECT rate_day, currency,
         {_RATE} + date_diff('day', date '{fx.FIRST_DAY}', rate_day) * {fx.FX_DRIFT}::double AS usd_rate
  FROM (SELECT rate_day, {_CODES} AS currency FROM {p}feed_days
        WHERE rate_day <= date '{fx.FEED_LAST_DAY}'))"""


REPAIRS = {
    "none": "amount",
    "blanket": "amount / 100",
    "cohort": f"case when payment_processor = '{fx.COHORT}' then amount / 100 else amount end",
}


def stage_ctes(fixture: str, p: str = "", repair: str = "none") -> str:
    """Adds ``stg_orders``, ``spine`` and ``stg_fx``; the fill is an as-of join here."""
    return orders_ctes(fixture, p) + f""",
{p}stg_orders AS (
  SELECT order_id, order_ts, cast(order_ts AS date) AS order_day, customer_id, currency,
         cast({REPAIRS[repair]} AS double) AS amount, payment_processor, status
  FROM {p}raw_orders WHERE status <> 'P'),
{p}span AS (SELECT min(order_day) AS d0, max(order_day) AS d1 FROM {p}stg_orders),
{p}days AS (
  SELECT cast(unnest(generate_series(cast(d0 AS timestamp), cast(d1 AS timestamp), interval 1 day)) AS date)
         AS rate_day FROM {p}span),
{p}spine AS (
  SELECT rate_day, currency FROM {p}days, (SELECT DISTINCT currency FROM {p}feed)),
{p}stg_fx AS (
  SELECT s.rate_day, s.currency, f.usd_rate
  FROM {p}spine s ASOF LEFT JOIN
       (SELECT f.* FROM {p}feed f, {p}span b
        WHERE f.rate_day BETWEEN b.d0 AND b.d1 AND f.usd_rate IS NOT NULL) f
    ON s.currency = f.currency AND s.rate_day >= f.rate_day
  UNION ALL
  SELECT rate_day, 'USD', 1.0::double FROM {p}days)"""


def mart_ctes(fixture: str, p: str = "", repair: str = "none") -> str:
    """Adds ``priced``, ``fct``, ``series`` (fct plus both reference medians) and ``kpi``."""
    return stage_ctes(fixture, p, repair) + f""",
{p}priced AS (
  SELECT o.*, f.usd_rate, o.amount * f.usd_rate AS usd
  FROM {p}stg_orders o JOIN {p}stg_fx f ON f.rate_day = o.order_day AND f.currency = o.currency),
{p}fct AS (
  SELECT order_day AS day, count(*) AS order_count, {rnd('sum(usd)', 2)} AS revenue_usd,
         {rnd('avg(usd)', 2)} AS aov_usd, {rnd('median(usd)', 2)} AS aov_median_usd
  FROM {p}priced GROUP BY order_day),
{p}series AS (
  SELECT a.*,
    (SELECT median(b.revenue_usd) FROM {p}fct b WHERE b.day BETWEEN a.day - 35 AND a.day - 8) AS reference,
    (SELECT median(b.revenue_usd) FROM {p}fct b WHERE b.day BETWEEN a.day - 14 AND a.day - 1) AS trailing_mid
  FROM {p}fct a),
{p}kpi AS (
  SELECT day AS kpi_day, revenue_usd AS revenue, {rnd('reference', 2)} AS trailing_28d_median_revenue,
         {rnd('revenue_usd / nullif(reference, 0)', 4)} AS anomaly_ratio
  FROM {p}series WHERE day = (SELECT max(day) FROM {p}fct))"""


def sql(ctes: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes.strip()}\n{body.strip()}"
