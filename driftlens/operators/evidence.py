"""The evidence ledger and its acceptance gates, for all incidents at once.

Citations are rows, not arrays, so an incident with very many facts spreads over
tasks; every gate is a join on (incident, evidence) and one combined aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from driftlens.functions.naming import urn_tail_name
from driftlens.functions.numeric import clamp

# Evidence kinds that carry numbers, the source of catalog facts, the
# default transport per source, and hypothesis states.
QUANTITATIVE = ("profile", "baseline_comparison")
METADATA_SOURCES = ("datahub", "metadata")
DEFAULT_TRANSPORT = {"warehouse": "duckdb", "pipeline": "pytest", "git": "git", "agent": "agent"}
DECIDING = ("eliminated", "confirmed")
LIVE = ("proposed", "investigating", "confirmed")
STATUS_ORDER = ("confirmed", "investigating", "proposed", "eliminated")
CONFIRMED_CONFIDENCE = 0.95

# Reasons a gate gives.
UNKNOWN_EVIDENCE = "one or more evidence ids do not exist"
NO_QUANTITATIVE = "no quantitative evidence cited"
NO_METADATA = "no metadata or lineage evidence cited"
NOT_TRAVERSED = "asset is not in the traversed lineage graph"
FIELD_MISSING = "quantitative evidence never references the field"
ASSET_MISSING = "quantitative evidence never references the asset"
NO_CITATIONS = "evidence ids are required"
UNKNOWN_HYPOTHESIS = "unknown hypothesis"


def resolve_transport(items: DataFrame, defaults: dict[str, str] = DEFAULT_TRANSPORT) -> DataFrame:
    """Transport of each fact: given, else the payload's ``via``, else by source."""
    by_source = F.lit(None).cast("string")
    for source, transport in defaults.items():
        by_source = F.when(F.col("source") == source, transport).otherwise(by_source)
    via = F.get_json_object("data", "$.via")
    return items.withColumn("transport", F.coalesce(F.col("transport"), via, by_source))


def append_items(ledger: DataFrame, items: DataFrame) -> DataFrame:
    return ledger.unionByName(resolve_transport(items))


def cited_items(citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Citations with the fact they name; ``kind`` is NULL for an unknown id."""
    facts = evidence.select("incident_id", "evidence_id", "kind", "source", "data")
    return citations.join(facts, ["incident_id", "evidence_id"], "left")


def missing_citations(citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Citations of ids that are not in the incident's ledger."""
    known = evidence.select("incident_id", "evidence_id")
    return citations.join(known, ["incident_id", "evidence_id"], "left_anti")


def is_quantitative() -> Column:
    return F.col("kind").isin(*QUANTITATIVE)


def _any(flag: Column) -> Column:
    return F.coalesce(F.bool_or(flag), F.lit(False))


def root_cause_gate(
    claims: DataFrame,
    citations: DataFrame,
    evidence: DataFrame,
    nodes: DataFrame,
    metadata_available: bool = True,
) -> DataFrame:
    """claim_id, accepted and every reason for rejection.

    ``claims``: claim_id, incident_id, asset_urn, field. ``citations``: claim_id,
    incident_id, evidence_id. ``nodes``: incident_id, urn of the traversed graph.
    Unknown ids are reported alone. Without metadata service the metadata and
    lineage conditions are waived.
    """
    text = F.lower(F.coalesce("data", F.lit("null")))
    about = claims.select(
        "claim_id", F.lower("field").alias("_field"), F.lower(urn_tail_name(F.col("asset_urn"))).alias("_asset")
    )
    facts = cited_items(citations, evidence).join(about, "claim_id").groupBy("claim_id").agg(
        F.count_if(F.col("kind").isNull()).alias("_missing"),
        _any(is_quantitative()).alias("_quant"),
        _any(F.col("source").isin(*METADATA_SOURCES)).alias("_meta"),
        _any(is_quantitative() & F.contains(text, F.col("_field"))).alias("_has_field"),
        _any(is_quantitative() & F.contains(text, F.col("_asset"))).alias("_has_asset"),
    )
    graph = nodes.select("incident_id", F.col("urn").alias("asset_urn"), F.lit(True).alias("_in_graph")).distinct()
    joined = claims.join(facts, "claim_id", "left").join(graph, ["incident_id", "asset_urn"], "left")

    def flag(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False))

    strict = F.lit(metadata_available)
    named = flag("_quant") & (F.coalesce(F.col("field"), F.lit("")) != "")
    problems = F.array_compact(
        F.array(
            F.when(~flag("_quant"), NO_QUANTITATIVE),
            F.when(strict & ~flag("_meta"), NO_METADATA),
            F.when(strict & ~flag("_in_graph"), NOT_TRAVERSED),
            F.when(named & ~flag("_has_field"), FIELD_MISSING),
            F.when(named & ~flag("_has_asset"), ASSET_MISSING),
        )
    )
    reasons = F.when(
        F.coalesce("_missing", F.lit(0)) > 0, F.array(F.lit(UNKNOWN_EVIDENCE))
    ).otherwise(problems)
    return joined.select(
        "claim_id", "incident_id", "asset_urn", "field", reasons.alias("reasons")
    ).withColumn("accepted", F.size("reasons") == 0)


def no_incident_gate(claims: DataFrame, citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Whether an all-clear may be declared: known citations, one of them quantitative."""
    facts = cited_items(citations, evidence).groupBy("claim_id").agg(
        F.count_if(F.col("kind").isNull()).alias("_missing"), _any(is_quantitative()).alias("_quant")
    )
    reason = (
        F.when(F.col("_missing").isNull(), NO_CITATIONS)
        .when(F.col("_missing") > 0, UNKNOWN_EVIDENCE)
        .when(~F.col("_quant"), NO_QUANTITATIVE)
    )
    return claims.join(facts, "claim_id", "left").select(
        "claim_id", "incident_id", reason.isNull().alias("accepted"), reason.alias("reason")
    )


def clear_open_nodes(nodes: DataFrame, cleared: DataFrame) -> DataFrame:
    """After an accepted all-clear, open nodes of the incident become healthy."""
    done = cleared.filter("accepted").select("incident_id", F.lit(True).alias("_done")).distinct()
    open_node = F.col("status").isin("investigating", "suspicious")
    return nodes.join(done, "incident_id", "left").withColumn(
        "status", F.when(F.col("_done") & open_node, "healthy").otherwise(F.col("status"))
    ).drop("_done")


def hypothesis_gate(updates: DataFrame, citations: DataFrame, evidence: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """Every update with its verdict.

    Eliminating or confirming needs at least one citation and no unknown one.
    ``updates``: update_id, incident_id, hypothesis_id, ts, status, confidence;
    ``citations``: update_id, incident_id, evidence_id.
    """
    facts = cited_items(citations, evidence).groupBy("update_id").agg(
        F.count_if(F.col("kind").isNull()).alias("_missing")
    )
    known = hypotheses.select("incident_id", "hypothesis_id", F.lit(True).alias("_known")).distinct()
    deciding = F.col("status").isin(*DECIDING)
    reason = (
        F.when(F.col("_known").isNull(), UNKNOWN_HYPOTHESIS)
        .when(deciding & F.col("_missing").isNull(), NO_CITATIONS)
        .when(deciding & (F.col("_missing") > 0), UNKNOWN_EVIDENCE)
    )
    return (
        updates.join(facts, "update_id", "left")
        .join(known, ["incident_id", "hypothesis_id"], "left")
        .withColumn("reason", reason)
        .withColumn("accepted", F.col("reason").isNull())
        .drop("_missing", "_known")
    )


def current_hypotheses(hypotheses: DataFrame, judged: DataFrame) -> DataFrame:
    """Hypotheses with the status and clamped confidence of their latest accepted update."""
    latest = judged.filter("accepted").groupBy("incident_id", "hypothesis_id").agg(
        F.max_by(F.struct("status", clamp(F.col("confidence")).alias("confidence")), F.struct("ts", "update_id")).alias("_u")
    )
    return hypotheses.join(latest, ["incident_id", "hypothesis_id"], "left").withColumns(
        {
            "status": F.coalesce(F.col("_u.status"), F.col("status")),
            "confidence": F.coalesce(F.col("_u.confidence"), F.col("confidence")),
        }
    ).drop("_u")


def merged_citations(judged: DataFrame, citations: DataFrame) -> DataFrame:
    """Evidence ids of each hypothesis in order of first citation, one row per id."""
    order = F.struct("ts", "update_id", "position")
    return (
        citations.join(judged.filter("accepted").select("update_id", "hypothesis_id", "ts"), "update_id")
        .groupBy("incident_id", "hypothesis_id", "evidence_id")
        .agg(F.min(order).alias("first_cited"))
    )


def merge_ids(left: Column, right: Column) -> Column:
    """Order-preserving union of two id lists."""
    return F.array_distinct(F.concat(left, right))


def node_status_from_hypotheses(nodes: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """Suspicious while a live hypothesis targets the node, healthy once all are eliminated."""
    by_target = hypotheses.groupBy("incident_id", F.col("target_urn").alias("urn")).agg(
        F.bool_or(F.col("status").isin(*LIVE)).alias("_live")
    )
    status = (
        F.when(F.col("_live") & F.col("status").isin("healthy", "investigating"), "suspicious")
        .when(~F.col("_live") & F.col("status").isin("suspicious", "investigating"), "healthy")
        .otherwise(F.col("status"))
    )
    return nodes.join(by_target, ["incident_id", "urn"], "left").withColumn("status", status).drop("_live")


def confirm_on_asset(hypotheses: DataFrame, accepted: DataFrame) -> DataFrame:
    """Hypotheses on an accepted cause are confirmed unless they were eliminated."""
    blamed = accepted.filter("accepted").select(
        "incident_id", F.col("asset_urn").alias("target_urn"), F.lit(True).alias("_blamed")
    ).distinct()
    hit = F.coalesce(F.col("_blamed"), F.lit(False)) & (F.col("status") != "eliminated")
    return hypotheses.join(blamed, ["incident_id", "target_urn"], "left").withColumns(
        {
            "status": F.when(hit, "confirmed").otherwise(F.col("status")),
            "confidence": F.when(
                hit, F.greatest(F.coalesce("confidence", F.lit(0.0)), F.lit(CONFIRMED_CONFIDENCE))
            ).otherwise(F.col("confidence")),
        }
    ).drop("_blamed")


def census(evidence: DataFrame, by: str = "source") -> DataFrame:
    """Facts per source, most first, then by name."""
    return evidence.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), by)


def has_required_kind(citations: DataFrame, evidence: DataFrame, kinds: tuple[str, ...] = QUANTITATIVE) -> DataFrame:
    """Whether the cited kinds of a claim meet the required kinds."""
    return cited_items(citations, evidence).groupBy("claim_id").agg(
        _any(F.col("kind").isin(*kinds)).alias("has_required")
    )


def timeline(evidence: DataFrame) -> DataFrame:
    return evidence.orderBy(F.desc("ts"), F.desc("evidence_id"))


def ranked_hypotheses(hypotheses: DataFrame) -> DataFrame:
    """Confirmed first, then investigating, proposed, eliminated."""
    rank = F.array_position(F.array(*[F.lit(s) for s in STATUS_ORDER]), F.col("status"))
    return hypotheses.withColumn("rank", rank).orderBy("rank", "hypothesis_id")


def digest(rows: DataFrame, keep: int, by: str = "evidence_id", position: str = "position") -> DataFrame:
    """The first ``keep`` rows of each fact's payload.

    The rank filter reaches below the shuffle (each task keeps at most ``keep`` rows
    of a group), so a payload of any size never meets in one task.
    """
    order = Window.partitionBy(by).orderBy(position)
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)
