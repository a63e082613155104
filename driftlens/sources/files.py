"""CSV, JSON and parquet sources and sinks of the incident workflow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from driftlens.operators.profile import daily_profile, range_profile, table_profile, value_counts
from driftlens.plans.revenue import Warehouse

# Declared columns of the raw extracts.
RAW_ORDERS = "order_id string, order_ts string, customer_id string, currency string, amount double, payment_processor string, status string"
RAW_CUSTOMERS = "customer_id string, name string, segment string, country string, created_at string"
RAW_FX_RATES = "rate_day string, currency string, usd_rate double"

DAILY_BASELINE = "day string, revenue_usd double, order_count bigint, aov_median_usd double"
PROFILE_BASELINE = (
    "stg_orders struct<per_day: array<struct<day: string, row_count: bigint, amount_median: double,"
    " amount_mean: double, amount_min: double, amount_max: double, amount_null_rate: double,"
    " payment_processors: array<string>>>>,"
    " stg_customers struct<row_count: bigint, customer_id_null_rate: double, segment_null_rate: double,"
    " segments: array<string>>,"
    " stg_fx_rates struct<row_count: bigint, usd_rate_null_rate: double, currencies: array<string>,"
    " usd_rate_min: double, usd_rate_max: double>"
)
TRANSCRIPT = (
    "incident_id string, phase string, turn bigint, stop_reason string, text string,"
    " tool_result_for string, result string, tools array<struct<name: string, input_keys: array<string>>>,"
    " usage struct<in: bigint, out: bigint>"
)
BAD_LINE = "_bad_line"
EVAL_RUN = (
    "run bigint, started_at string, finished_at string, results array<struct<scenario: string, status: string,"
    " checks: map<string, boolean>, notes: array<string>, incident_id: string, wall_time_s: double, trial: int>>"
)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with header and declared types; a missing file or a bad row is an error."""
    return (
        spark.read.schema(schema).option("header", True).option("mode", "FAILFAST")
        .option("enforceSchema", False).csv(path)
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_document(rows: DataFrame, path: str, array: bool = False) -> None:
    """One JSON document from an already bounded result (a calendar, a KPI row)."""
    body = F.to_json(F.struct(*rows.columns))
    if array:
        listed = F.array_sort(F.collect_list(F.struct(*rows.columns)))
        rows.agg(F.to_json(listed).alias("value")).write.mode("overwrite").text(path)
    else:
        rows.select(body.alias("value")).write.mode("overwrite").text(path)


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """Daily baseline from a JSON array (or one object per file), keyed by date."""
    raw = spark.read.schema(DAILY_BASELINE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return raw.withColumn("day", F.to_date("day"))


def capture_baseline(daily: DataFrame, path: str) -> None:
    """Record the daily series of a healthy build; one row per calendar day."""
    write_document(
        daily.select(F.col("day").cast("string").alias("day"), "revenue_usd", "order_count", "aov_median_usd"),
        path, array=True,
    )


def capture_profiles(wh: Warehouse, customers: DataFrame, path: str) -> None:
    """Record the nested profile baseline of a healthy build."""
    per_day = daily_profile(wh.stg_orders).withColumn("day", F.col("day").cast("string"))
    parts = {
        "stg_orders": per_day.agg(F.array_sort(F.collect_list(F.struct(*per_day.columns))).alias("per_day")),
        "stg_customers": with_list(table_profile(customers, ["customer_id", "segment"], "segment"), customers, "segment", "segments"),
        "stg_fx_rates": with_list(range_profile(wh.stg_fx_rates, "usd_rate", "currency"), wh.stg_fx_rates, "currency", "currencies"),
    }
    # Three one-row parts become one document: a union of rows, folded by column.
    schema = T.StructType.fromDDL(PROFILE_BASELINE)
    rows = None
    for name, df in parts.items():
        row = df.select(
            *[
                (F.struct(*f.dataType.names) if f.name == name else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in schema.fields
            ]
        )
        rows = row if rows is None else rows.unionByName(row)
    write_document(
        rows.agg(*[F.first(f.name, ignorenulls=True).alias(f.name) for f in schema.fields]), path
    )


def with_list(profile: DataFrame, df: DataFrame, column: str, name: str) -> DataFrame:
    """A one-row profile with the sorted values of ``column``, which the document holds as a list."""
    listed = value_counts(df, column).filter(F.col("value").isNotNull()).agg(F.array_sort(F.collect_list("value")).alias(name))
    return profile.join(listed).drop("distinct_values")  # both sides are one row


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROFILE_BASELINE).option("multiLine", True).option("mode", "FAILFAST").json(path)


def profile_days(profiles: DataFrame) -> DataFrame:
    return profiles.select(F.inline("stg_orders.per_day")).withColumn("day", F.to_date("day"))


def write_snapshot(wh: Warehouse, path: str) -> None:
    """One document: the KPI row and the ordered daily series."""
    daily = wh.fct_revenue.agg(
        F.array_sort(
            F.collect_list(
                F.struct(F.col("day").cast("string").alias("day"), "revenue_usd", "order_count", "aov_median_usd")
            )
        ).alias("daily")
    )
    kpi = wh.exec_revenue_metric.select(
        F.col("kpi_day").cast("string").alias("kpi_day"), "revenue",
        F.col("trailing_28d_median_revenue").alias("expected_revenue"), "anomaly_ratio",
    )
    write_document(kpi.join(F.broadcast(daily)), path)  # both sides are one row


SNAPSHOT = (
    "kpi_day string, revenue double, expected_revenue double, anomaly_ratio double,"
    " daily array<struct<day: string, revenue_usd: double, order_count: bigint, aov_median_usd: double>>"
)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SNAPSHOT).option("multiLine", True).option("mode", "FAILFAST").json(path)


def _transcript_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line, with its text in BAD_LINE where it is malformed, and the file that it stands in."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).filter(F.trim("value") != "")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD_LINE}
    parsed = lines.withColumn("_line", F.from_json("value", f"{TRANSCRIPT}, {BAD_LINE} string", options))
    bad = F.when(F.col("_line").isNull() | F.col(f"_line.{BAD_LINE}").isNotNull(), F.col("value"))
    return parsed.select("_line.*", "file", bad.alias("_bad")).drop(BAD_LINE).withColumnRenamed("_bad", BAD_LINE)


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; malformed lines are left out (``quarantine`` keeps them)."""
    return _transcript_lines(spark, path).filter(F.col(BAD_LINE).isNull()).drop(BAD_LINE, "file")


#: A malformed line with its file, why it was rejected and the incident that it still names.
NAMED = r'"incident_id"\s*:\s*"((?:[^"\\]|\\.)*)"'
REJECTED = "file string, reason string, incident_id string, line string"


def quarantine(spark: SparkSession, path: str, rejects: str) -> tuple[DataFrame, DataFrame]:
    """(good lines, rejected lines): what the transcript's schema does not hold is written to ``rejects``.

    A line is rejected as a whole: fields that could be read before the fault are not used.
    """
    lines = _transcript_lines(spark, path)
    bad = F.col(BAD_LINE)
    reason = F.when(F.try_parse_json(bad).isNull(), "not JSON").otherwise("not a transcript line")
    named = F.nullif(F.regexp_extract(bad, NAMED, 1), F.lit(""))
    lines.filter(bad.isNotNull()).select(
        "file", reason.alias("reason"), named.alias("incident_id"), bad.alias("line")
    ).write.mode("error").parquet(rejects)
    return lines.filter(bad.isNull()).drop(BAD_LINE, "file"), spark.read.schema(REJECTED).parquet(rejects)


INCIDENT_DOC = (
    "id string, report_text string, stage string, created_at string, updated_at string,"
    " root_cause struct<summary: string, asset_urn: string, field: string, detail: string, evidence_ids: array<string>>,"
    " evidence array<struct<id: string, ts: string, kind: string, source: string, title: string>>,"
    " hypotheses array<struct<id: string, target_urn: string, status: string, confidence: double>>,"
    " error string"
)


def read_incidents(spark: SparkSession, path: str, one_per_file: bool = False) -> DataFrame:
    """Incident documents: JSON lines, or one indented document per file."""
    return spark.read.schema(INCIDENT_DOC).option("multiLine", one_per_file).option("mode", "FAILFAST").json(path)


#: Evidence as rows keyed by incident: a hot incident's list fits no document.
EVIDENCE_ROW = "incident_id string, id string, ts string, kind string, source string, title string"


def read_incident_evidence(spark: SparkSession, path: str) -> DataFrame:
    """Every evidence item of the incident documents: JSON lines."""
    return spark.read.schema(EVIDENCE_ROW).option("mode", "FAILFAST").json(path)


def incident_ids(incidents: DataFrame) -> DataFrame:
    return incidents.select("id").orderBy("id")


def incident(incidents: DataFrame, incident_id: str) -> DataFrame:
    return incidents.filter(F.col("id") == incident_id)


def read_eval_runs(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """One row per scenario and trial."""
    runs = spark.read.schema(EVAL_RUN).option("multiLine", one_per_file).option("mode", "FAILFAST").json(path)
    return runs.select("run", F.inline("results"))
