"""Incident stages, records and outcome rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from driftlens.functions.numeric import round_to

# The order stages advance in, and the two exits.
STAGES = (
    "REPORTED", "CONTEXT_DISCOVERY", "LINEAGE_TRAVERSAL", "HYPOTHESIS_GENERATION", "EVIDENCE_COLLECTION",
    "ROOT_CAUSE_CONFIRMED", "REPAIR_GENERATED", "REPAIR_TESTING", "VERIFIED", "WRITEBACK_COMPLETE",
)
EXITS = ("NO_INCIDENT", "FAILED")
TERMINAL_OK = ("WRITEBACK_COMPLETE", "VERIFIED", "NO_INCIDENT")


def stage_rank(stage: Column) -> Column:
    """Position in the stage order, 0 for REPORTED; NULL for an exit or unknown name."""
    at = F.array_position(F.array(*[F.lit(s) for s in STAGES]), stage)
    return F.when(at > 0, (at - 1).cast("int"))


def _exit_order(events: DataFrame) -> Column:
    """One comparable value for (ts, event_id).

    For integer ids it is a decimal, which hash aggregation can update in place; a
    struct would force a sort of every event before the first combine. The factor
    exceeds the range of a shifted 64-bit id, so the timestamp always decides first.
    """
    if isinstance(events.schema["event_id"].dataType, (T.LongType, T.IntegerType)):
        return F.expr(
            "cast(unix_micros(cast(ts AS timestamp)) AS decimal(17,0)) * 100000000000000000000"
            " + (cast(event_id AS decimal(19,0)) + 9223372036854775808)"
        )
    return F.struct("ts", "event_id")


def fold_aggregates(events: DataFrame) -> list[Column]:
    """The stage fold as plain aggregates over (ts, event_id, target_stage).

    Ordinary stages only move forward, so before any exit the stage is the highest
    one reached. Exits are always reachable and block ordinary stages after them, so
    once there is an exit the stage is the last exit. All are order-free aggregates:
    no incident's history has to be sorted in one task, and a stream can keep them.
    """
    order = _exit_order(events)
    return [
        F.max(stage_rank(F.col("target_stage"))).alias("_rank"),
        *[F.max(F.when(F.col("target_stage") == e, order)).alias(f"_{e.lower()}") for e in EXITS],
        F.count(F.lit(1)).alias("events"),
        F.max("ts").alias("_last"),
    ]


def folded_stage() -> Column:
    by_rank = F.element_at(F.array(*[F.lit(s) for s in STAGES]), F.coalesce("_rank", F.lit(0)) + 1)
    first, second = EXITS
    a, b = F.col(f"_{first.lower()}"), F.col(f"_{second.lower()}")
    return (
        F.when(a.isNull() & b.isNull(), by_rank)
        .when(b.isNull() | (a > b), F.lit(first))
        .otherwise(F.lit(second))
    )


def fold_stages(events: DataFrame) -> DataFrame:
    """Final stage per incident."""
    return events.groupBy("incident_id").agg(*fold_aggregates(events)).select(
        "incident_id", folded_stage().alias("stage"), "events"
    )


def terminal_class(stage: Column, repair_authorised: Column) -> Column:
    """The stage an investigation ends in: a stage that is no valid end becomes FAILED."""
    pause = (stage == "ROOT_CAUSE_CONFIRMED") & ~repair_authorised
    return F.when(stage.isin(*TERMINAL_OK) | pause, stage).otherwise("FAILED")


def latest_incident(incidents: DataFrame) -> DataFrame:
    """The incident created last."""
    row = incidents.agg(F.max_by(F.struct("*"), F.struct("created_at", "incident_id")).alias("i"))
    return row.select("i.*")


def incident_list(incidents: DataFrame) -> DataFrame:
    return incidents.select("incident_id", "stage", "report_text", "created_at").orderBy(
        F.desc("created_at"), F.desc("incident_id")
    )


def without(incidents: DataFrame, ids: DataFrame) -> DataFrame:
    """The incident set after clearing the given ids."""
    return incidents.join(ids.select("incident_id").distinct(), "incident_id", "left_anti")


def raised_records(causes: DataFrame, nodes: DataFrame) -> DataFrame:
    """ACTIVE records over the cause and its affected assets, one row per asset."""
    affected = nodes.filter(F.col("status").isin("affected", "root_cause")).select("incident_id", "urn")
    assets = causes.select("incident_id", F.col("asset_urn").alias("urn")).unionByName(affected)
    return assets.distinct().join(causes.select("incident_id", "ts", "summary"), "incident_id").select(
        "incident_id", "urn", "ts",
        F.lit("ACTIVE").alias("state"),
        F.lit("INVESTIGATION").alias("phase"),
        F.col("summary").alias("title"),
        F.concat(F.lit("Root cause: "), F.coalesce("summary", F.lit("")), F.lit("\nAsset: "), F.col("urn").cast("string")).alias("description"),
        F.lit(None).cast("string").alias("message"),
    )


def resolved_records(raised: DataFrame, repairs: DataFrame) -> DataFrame:
    """RESOLVED / FIXED versions of raised records whose repair was verified."""
    fixed = repairs.select("incident_id", F.col("ts").alias("_ts"))
    return raised.join(fixed, "incident_id").select(
        "incident_id", "urn", F.col("_ts").alias("ts"),
        F.lit("RESOLVED").alias("state"), F.lit("FIXED").alias("phase"), "title", "description",
        F.concat(F.lit("Verified repair of: "), F.coalesce("title", F.lit(""))).alias("message"),
    )


def upsert_latest(current: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Newest version per key of two sets of rows.

    At equal times a change wins over what was there, and further ties go to the larger
    row, so the result does not depend on the order in which rows arrive.
    """
    rest = [c for c in current.columns if c not in keys]
    both = current.withColumn("_rank", F.lit(0)).unionByName(changes.withColumn("_rank", F.lit(1)))
    newest = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, "_rank", *rest)).alias("_v"))
    return newest.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in rest])


def writeback_status(raised: Column, updated: Column) -> Column:
    """complete, partial (raised, but the update failed) or pending."""
    return F.when(raised & updated, "complete").when(raised, "partial").otherwise("pending")


def outcome_rollup(
    incidents: DataFrame, evidence: DataFrame, hypotheses: DataFrame, checks: DataFrame
) -> DataFrame:
    """Stage, confirmation, counts, n/N checks and KPI ratios per incident."""
    n_evidence = evidence.groupBy("incident_id").agg(F.count(F.lit(1)).alias("evidence_items"))
    n_hypotheses = hypotheses.groupBy("incident_id").agg(F.count(F.lit(1)).alias("hypotheses"))
    tallies = checks.groupBy("incident_id").agg(
        F.count_if("passed").alias("_passed"), F.count(F.lit(1)).alias("_total")
    )
    out = incidents
    for part in (n_evidence, n_hypotheses, tallies):
        out = out.join(part, "incident_id", "left")
    return out.select(
        "incident_id", "stage",
        F.col("root_cause_urn").isNotNull().alias("root_cause_confirmed"),
        F.coalesce("evidence_items", F.lit(0)).alias("evidence_items"),
        F.coalesce("hypotheses", F.lit(0)).alias("hypotheses"),
        F.when(F.col("_total").isNotNull(), F.concat("_passed", F.lit("/"), "_total")).alias("checks"),
        (F.col("_passed") == F.col("_total")).alias("all_passed"),
        round_to(F.col("ratio_before"), 4).alias("ratio_before"),
        round_to(F.col("ratio_after"), 4).alias("ratio_after"),
    )
