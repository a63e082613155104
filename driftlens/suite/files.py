"""Sources and sinks: each query writes derived data to scratch and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftlens.functions import numeric as N
from driftlens.operators import catalog
from driftlens.plans import revenue as R
from driftlens.session import scratch_dir
from driftlens.sources import files as S, publish
from driftlens.suite import inputs as fx
from driftlens.suite.ledger import GRADED, _RUN, checked_runs, graded_evidence, graded_incidents
from driftlens.suite.oracle import mart_ctes, orders_ctes, rnd, sql
from driftlens.suite.registry import query
from driftlens.suite.revenue import incident_build, natural_build

_WIRE = "strftime(order_ts, '%Y-%m-%dT%H:%M:%SZ')"


@query(
    "S1_csv_scan",
    sql(orders_ctes("natural"), f"""SELECT cast(order_id AS varchar) AS order_id, {_WIRE} AS order_ts,
        cast(customer_id AS varchar) AS customer_id, currency, amount, payment_processor, status FROM raw_orders"""),
)
def csv_scan(spark, sf):
    wire = fx.natural_orders(spark, sf).withColumns(
        {
            "order_id": F.col("order_id").cast("string"),
            "customer_id": F.col("customer_id").cast("string"),
            "order_ts": F.date_format("order_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        }
    )
    path = scratch_dir(spark, "csv")
    S.write_csv(wire, path)
    return S.read_csv(spark, path, S.RAW_ORDERS)


@query(
    "S1_csv_build",
    sql(mart_ctes("natural"), "SELECT * FROM fct"),
)
def csv_build(spark, sf):
    """The daily fact from CSV extracts, as a fresh checkout would build it."""
    feed_path = scratch_dir(spark, "csv-feed")
    feed = fx.natural_feed(spark, sf).withColumn("rate_day", F.col("rate_day").cast("string"))
    S.write_csv(feed, feed_path)
    return R.build(csv_scan(spark, sf), S.read_csv(spark, feed_path, S.RAW_FX_RATES), fx.EXCLUDED).fct_revenue


@query(
    "S2_full_refresh",
    sql(mart_ctes("natural"), """SELECT 'stg_orders' AS layer, count(*) AS n FROM stg_orders
        UNION ALL SELECT 'stg_fx_rates', count(*) FROM stg_fx UNION ALL SELECT 'fct_revenue', count(*) FROM fct
        UNION ALL SELECT 'exec_revenue_metric', count(*) FROM kpi"""),
)
def full_refresh(spark, sf):
    """Every layer from the stored one before it, all switched at once; a second run replaces the first."""
    root = scratch_dir(spark, "warehouse")
    steps = R.layer_steps(fx.natural_orders(spark, sf), fx.natural_feed(spark, sf), fx.EXCLUDED)
    publish.publish(spark, root, steps)
    publish.publish(spark, root, steps)
    layers = publish.read(spark, root)
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("layer"), "n") for name, df in layers.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def _described(layer: str, source: str, columns: str) -> str:
    names = columns.split()
    kinds = ", ".join(f"typeof({c})" for c in names)
    return f"""SELECT '{layer}' AS urn, unnest([{", ".join(f"'{c}'" for c in names)}]) AS field,
        unnest([{kinds}]) AS kind, unnest(range(0, {len(names)}))::integer AS position FROM (SELECT * FROM {source} LIMIT 1)"""


_LAYERS = " UNION ALL ".join([
    _described("stg_orders", "stg_orders", "order_id order_ts order_day customer_id currency amount payment_processor status"),
    _described("stg_fx_rates", "stg_fx", "rate_day currency usd_rate"),
    _described("fct_revenue", "fct", "day order_count revenue_usd aov_usd aov_median_usd"),
])


@query(
    "S9_introspected_layers",
    sql(mart_ctes("natural"), f"""SELECT urn, field, case kind when 'VARCHAR' then 'string' when 'TIMESTAMP' then 'timestamp_ntz'
        else lower(kind) end AS type, position FROM ({_LAYERS})"""),
)
def introspected_layers(spark, sf):
    """Schemas of the published layers, as their files have them."""
    root = scratch_dir(spark, "warehouse")
    steps = R.layer_steps(fx.natural_orders(spark, sf), fx.natural_feed(spark, sf), fx.EXCLUDED)
    del steps["exec_revenue_metric"]
    publish.publish(spark, root, steps)
    return catalog.introspect(publish.read(spark, root))


_DAILY = "SELECT day, revenue_usd, order_count, aov_median_usd FROM fct"


@query("S3_baseline_scan", sql(mart_ctes("healthy"), _DAILY))
def baseline_scan(spark, sf):
    path = scratch_dir(spark, "baseline-json")
    S.capture_baseline(incident_build(spark, sf, "healthy").fct_revenue, path)
    return S.read_baseline(spark, path)


@query("S10_baseline_capture", sql(mart_ctes("natural"), _DAILY))
def baseline_capture(spark, sf):
    path = scratch_dir(spark, "baseline-json")
    S.capture_baseline(natural_build(spark, sf).fct_revenue, path)
    return S.read_baseline(spark, path)


@query(
    "S4_profile_baseline_scan",
    sql(mart_ctes("healthy"), f"""SELECT order_day AS day, count(*) AS row_count, {rnd('median(amount)', 2)} AS amount_median,
      {rnd('avg(amount)', 2)} AS amount_mean, {rnd('min(amount)', 2)} AS amount_min, {rnd('max(amount)', 2)} AS amount_max,
      {rnd('avg(case when amount is null then 1.0 else 0.0 end)', 6)} AS amount_null_rate,
      string_agg(DISTINCT payment_processor, ',' ORDER BY payment_processor) AS payment_processors FROM stg_orders GROUP BY 1"""),
)
def profile_baseline_scan(spark, sf):
    path = scratch_dir(spark, "profiles")
    customers = R.stage_customers(fx.raw_customers(spark, sf))
    S.capture_profiles(incident_build(spark, sf, "healthy"), customers, path)
    return S.profile_days(S.read_profiles(spark, path)).withColumn(
        "payment_processors", F.array_join("payment_processors", ",")
    )


@query(
    "S5_kpi_snapshot",
    sql(mart_ctes("incident"), """SELECT cast(kpi_day AS varchar) AS kpi_day, revenue, trailing_28d_median_revenue AS expected_revenue,
        anomaly_ratio, cast(day AS varchar) AS day, revenue_usd, order_count, aov_median_usd FROM kpi, fct"""),
)
def kpi_snapshot(spark, sf):
    path = scratch_dir(spark, "snapshot")
    S.write_snapshot(incident_build(spark, sf, store=True), path)
    return S.read_snapshot(spark, path).select(
        "kpi_day", "revenue", "expected_revenue", "anomaly_ratio", F.inline("daily")
    )


@query(
    "S6_transcript_scan",
    """SELECT cast(conv_id AS varchar) AS incident_id, turn, case when role = 'assistant' then 'tool_use' end AS stop_reason,
       case when role = 'user' then 'run_sql' end AS tool_result_for, case when role = 'assistant' then text end AS text
       FROM conversations WHERE role <> 'system'""",
)
def transcript_scan(spark, sf):
    """System rows become malformed lines, which the reader has to leave out."""
    path = scratch_dir(spark, "transcripts")
    write_transcripts(spark, sf, path)
    return S.read_transcripts(spark, path).select("incident_id", "turn", "stop_reason", "tool_result_for", "text")


def write_transcripts(spark, sf, path: str) -> None:
    """Conversations as transcript lines; system rows break off, every third in a field of the wrong type."""
    model = F.col("role") == "assistant"
    line = F.to_json(
        F.struct(
            F.col("conv_id").cast("string").alias("incident_id"), F.lit("investigation").alias("phase"), "turn",
            F.when(model, "tool_use").alias("stop_reason"),
            F.when(model, F.col("text")).alias("text"),
            F.when(~model, "run_sql").alias("tool_result_for"),
            F.when(~model, F.col("text")).alias("result"),
            F.when(model, F.array(F.struct(F.lit("run_sql").alias("name"), F.array(F.lit("query")).alias("input_keys")))).alias("tools"),
            F.when(model, F.struct((F.length("text") + 100).alias("in"), F.length("text").alias("out"))).alias("usage"),
        )
    )
    head = F.concat(F.lit('{"incident_id": "'), F.col("conv_id").cast("string"), F.lit('", "turn": '))
    broken = F.when(F.col("conv_id") % 3 == 0, F.concat(head, F.lit('{"no": "number"}}'))).otherwise(
        F.concat(head, F.col("turn").cast("string"))
    )
    fx.table(spark, sf, "conversations").select(
        F.when(F.col("role") == "system", broken).otherwise(line).alias("value")
    ).write.mode("overwrite").text(path)


@query(
    "S6_transcript_usage",
    """SELECT cast(conv_id AS varchar) AS incident_id, count(*) FILTER (WHERE role <> 'system') AS good_lines,
       count(*) FILTER (WHERE role = 'system' AND conv_id % 3 <> 0) AS not_json,
       count(*) FILTER (WHERE role = 'system' AND conv_id % 3 = 0) AS not_a_line,
       count(*) FILTER (WHERE role = 'assistant') AS tool_calls,
       coalesce(sum(length(text) + 100) FILTER (WHERE role = 'assistant'), 0)::bigint AS tokens_in,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::bigint AS tokens_out
       FROM conversations GROUP BY 1""",
)
def transcript_usage(spark, sf):
    """Good and quarantined lines, tool calls and tokens of every run."""
    path = scratch_dir(spark, "transcripts")
    write_transcripts(spark, sf, path)
    good, rejected = S.quarantine(spark, path, f"{path}-rejected")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("string")
    both = good.select("incident_id", none.alias("reason"), F.coalesce(F.size("tools"), F.lit(0)).alias("calls"), "usage.in", "usage.out")
    both = both.unionByName(rejected.select("incident_id", "reason", F.lit(0).alias("calls"), zero.alias("in"), zero.alias("out")))
    return both.groupBy("incident_id").agg(
        F.count_if(F.col("reason").isNull()).alias("good_lines"),
        F.count_if(F.col("reason") == "not JSON").alias("not_json"),
        F.count_if(F.col("reason") == "not a transcript line").alias("not_a_line"),
        F.sum(F.greatest("calls", F.lit(0))).alias("tool_calls"),
        F.coalesce(F.sum("in"), zero).alias("tokens_in"), F.coalesce(F.sum("out"), zero).alias("tokens_out"),
    )


def write_incidents(spark, sf, path: str) -> None:
    cause = F.when(
        F.col("cause_urn").isNotNull(),
        F.struct(
            F.col("cause_summary").alias("summary"), F.col("cause_urn").alias("asset_urn"),
            F.col("cause_field").alias("field"), F.col("cause_detail").alias("detail"),
        ),
    )
    graded_incidents(spark, sf).select(
        F.concat(F.lit("inc_"), "incident_id").alias("id"), F.col("cause_detail").alias("report_text"), "stage",
        F.col("created_at").cast("string").alias("created_at"), cause.alias("root_cause"),
    ).write.mode("overwrite").json(path)


def write_evidence(spark, sf, path: str) -> None:
    graded_evidence(spark, sf).select(
        F.concat(F.lit("inc_"), "incident_id").alias("incident_id"), F.col("evidence_id").alias("id"), "kind", "source", "title"
    ).write.mode("overwrite").json(path)


@query(
    "S7_incident_documents",
    sql(GRADED, """SELECT 'inc_' || i.incident_id AS id, stage, cause_urn, coalesce(n, 0) AS evidence_items,
        coalesce(k, 0) AS distinct_ids, first_id, last_id FROM inc i
        LEFT JOIN (SELECT incident_id, count(*) AS n, count(DISTINCT evidence_id) AS k, min(evidence_id) AS first_id,
                          max(evidence_id) AS last_id FROM ev GROUP BY 1) e ON i.incident_id = e.incident_id"""),
)
def incident_documents(spark, sf):
    """Incident documents and all their evidence rows, written as JSON lines and scanned back."""
    path = scratch_dir(spark, "incidents")
    write_incidents(spark, sf, path)
    write_evidence(spark, sf, f"{path}-evidence")
    counted = S.read_incident_evidence(spark, f"{path}-evidence").groupBy(F.col("incident_id").alias("of")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("k"), F.min("id").alias("first_id"), F.max("id").alias("last_id")
    )
    return S.read_incidents(spark, path).join(counted, F.col("id") == F.col("of"), "left").select(
        "id", "stage", F.col("root_cause.asset_urn").alias("cause_urn"), F.coalesce("n", F.lit(0)).alias("evidence_items"),
        F.coalesce("k", F.lit(0)).alias("distinct_ids"), "first_id", "last_id",
    )


@query(
    "S7_evidence_rows",
    sql(GRADED, """SELECT 'inc_' || incident_id AS incident_id, evidence_id AS id, kind, source, title FROM ev"""),
)
def evidence_rows(spark, sf):
    """Every evidence item as the file gives it back."""
    path = scratch_dir(spark, "evidence")
    write_evidence(spark, sf, path)
    return S.read_incident_evidence(spark, path).select("incident_id", "id", "kind", "source", "title")


@query(
    "S7_incident_fetch",
    sql(GRADED, """SELECT 'inc_' || incident_id AS id, stage, cause_detail AS report_text, cause_urn, cause_field,
        case when cause_urn is not null then cause_summary end AS cause_summary,
        case when cause_urn is not null then cause_detail end AS cause_detail FROM inc WHERE incident_id = 42"""),
)
def incident_fetch(spark, sf):
    """One document with its own and its root cause's fields."""
    path = scratch_dir(spark, "incidents")
    write_incidents(spark, sf, path)
    cause = [F.col(f"root_cause.{c}").alias(f"cause_{n}") for c, n in (("asset_urn", "urn"), ("field", "field"), ("summary", "summary"), ("detail", "detail"))]
    return S.incident(S.read_incidents(spark, path), "inc_42").select("id", "stage", "report_text", *cause)


@query("S7_incident_ids", "SELECT 'inc_' || o_orderkey AS id FROM orders")
def incident_ids(spark, sf):
    path = scratch_dir(spark, "incidents")
    write_incidents(spark, sf, path)
    return S.incident_ids(S.read_incidents(spark, path))


@query(
    "S8_eval_results",
    sql(GRADED + "," + _RUN, """SELECT incident_id AS run, scenario, status, t.trial, status = 'passed' AS verified
        FROM runs, (SELECT unnest([1, 2]) AS trial) t"""),
)
def eval_results(spark, sf):
    """Run documents with two trials each and all their checks, exploded to one row per trial."""
    path = scratch_dir(spark, "eval-runs")
    write_eval_runs(spark, sf, path)
    passed = F.forall(F.map_values("checks"), lambda ok: ok)
    return S.read_eval_runs(spark, path, one_per_file=False).select(
        "run", "scenario", "status", "trial", F.coalesce(passed, F.lit(False)).alias("verified")
    )


def write_eval_runs(spark, sf, path: str) -> None:
    """A run that was skipped or broke off has no checks."""

    def trial(n: int):
        return F.struct(
            "scenario", "status", "checks", F.concat(F.lit("inc_"), "incident_id").alias("incident_id"), F.lit(n).alias("trial")
        )

    checked_runs(spark, sf).select(
        F.col("incident_id").alias("run"), F.array(trial(1), trial(2)).alias("results")
    ).write.mode("overwrite").json(path)
