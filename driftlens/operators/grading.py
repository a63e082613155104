"""Deterministic grades over finished incidents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from driftlens.functions.numeric import round_to, safe_ratio
from driftlens.operators.baseline import KPI_BAND
from driftlens.operators.evidence import METADATA_SOURCES, QUANTITATIVE

# Wording that shows the unit defect was understood, the least number of
# checks a verified repair has to pass, and the stages a repaired incident ends in.
SEMANTIC_PATTERN = r"(?i)(cent|minor.?unit|100(x|×)|scal(e|ing)|unit)"
MIN_CHECKS = 30
FINISHED = ("VERIFIED", "WRITEBACK_COMPLETE")


@dataclass(frozen=True)
class AnswerKey:
    """What a correct investigation of a scenario blames and repairs.

    ``cohort_words`` name the defective cohort: a repair is targeted when its added
    lines mention one of them.
    """

    origin_suffix: str
    accepted_suffixes: tuple[str, ...]
    field: str
    repair_file: str
    distractor: str
    cohort_words: tuple[str, ...]


def _true(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False))


def transcript_stats(lines: DataFrame) -> DataFrame:
    """Model turns and tool calls per incident."""
    turn = F.col("stop_reason").isNotNull()
    return lines.groupBy("incident_id").agg(
        F.count_if(turn).alias("turns"),
        F.count_if(~turn & F.col("tool_result_for").isNotNull()).alias("tool_calls"),
    )


def cause_correct(urn: Column, field: Column, key: AnswerKey) -> Column:
    suffix = F.lit(False)
    for s in key.accepted_suffixes:
        suffix = suffix | urn.endswith(s)
    return _true(suffix & (field == key.field))


def blamed_origin(urn: Column, key: AnswerKey) -> Column:
    return _true(urn.endswith(key.origin_suffix))


def evidence_facts(evidence: DataFrame, citations: DataFrame) -> DataFrame:
    """Per incident: catalog lineage present, quantitative evidence cited, distractor seen."""
    kinds = evidence.select("incident_id", "evidence_id", "kind", "source", "title")
    cited = citations.select("incident_id", "evidence_id", F.lit(True).alias("_cited")).distinct()
    return kinds.join(cited, ["incident_id", "evidence_id"], "left").groupBy("incident_id").agg(
        F.bool_or(F.col("source").isin(*METADATA_SOURCES) & (F.col("kind") == "lineage")).alias("catalog_lineage"),
        F.bool_or(_true(F.col("_cited")) & F.col("kind").isin(*QUANTITATIVE)).alias("cited_quantitative"),
        F.bool_or(F.contains(F.lower("title"), F.lit("fx"))).alias("distractor_examined"),
        F.count(F.lit(1)).alias("evidence_items"),
    )


def grade_positive(incidents: DataFrame, facts: DataFrame, key: AnswerKey) -> DataFrame:
    """Eleven checks per incident, plus two reported metrics."""
    c = F.col
    words = [F.contains(F.lower("patch_added"), F.lit(w.lower())) for w in key.cohort_words]
    targeted = words[0]
    for w in words[1:]:
        targeted = targeted | w
    text = F.concat_ws(" ", "cause_summary", "cause_detail")
    has_cause = c("cause_urn").isNotNull()
    return incidents.join(facts, "incident_id", "left").select(
        "incident_id",
        c("stage").isin(*FINISHED).alias("terminal_ok"),
        cause_correct(c("cause_urn"), c("cause_field"), key).alias("root_cause_correct"),
        (has_cause & text.rlike(SEMANTIC_PATTERN)).alias("semantic_identified"),
        (~_true(F.contains("cause_urn", F.lit(key.distractor)))).alias("distractor_avoided"),
        _true(c("patch_file") == key.repair_file).alias("repair_correct_file"),
        _true(
            (c("checks_failed") == 0) & (c("checks_total") >= MIN_CHECKS) & c("ratio_after").between(*KPI_BAND)
        ).alias("repair_verified"),
        _true(targeted).alias("repair_targeted"),
        _true(c("baseline_restored")).alias("repair_restores_baseline"),
        F.forall(
            F.coalesce("changed_files", F.array().cast("array<string>")), lambda f: f == F.lit(key.repair_file)
        ).alias("repair_single_file"),
        (_true(c("catalog_lineage")) & _true(c("cited_quantitative"))).alias("evidence_coverage"),
        _true((c("writeback_status") == "complete") & c("writeback_urn").isNotNull()).alias("writeback_done"),
        blamed_origin(c("cause_urn"), key).alias("blamed_most_upstream"),
        _true(c("distractor_examined")).alias("distractor_examined"),
    )


POSITIVE_CHECKS = (
    "terminal_ok", "root_cause_correct", "semantic_identified", "distractor_avoided", "repair_correct_file",
    "repair_verified", "repair_targeted", "repair_restores_baseline", "repair_single_file", "evidence_coverage",
    "writeback_done",
)


def grade_control(incidents: DataFrame) -> DataFrame:
    """A healthy run must end in an all-clear and leave everything alone."""
    return incidents.select(
        "incident_id",
        (F.col("stage") == "NO_INCIDENT").alias("stage_no_incident"),
        F.col("patch_file").isNull().alias("no_patch"),
        (F.size(F.coalesce("changed_files", F.array().cast("array<string>"))) == 0).alias("transforms_unchanged"),
        F.col("cause_urn").isNull().alias("no_false_positive"),
    )


def grade_ablation(incidents: DataFrame, transcripts: DataFrame, key: AnswerKey) -> DataFrame:
    """Without metadata: the run took turns and raised no false all-clear; accuracy is reported."""
    return incidents.join(transcripts, "incident_id", "left").select(
        "incident_id",
        (F.coalesce("turns", F.lit(0)) > 0).alias("run_executed"),
        (F.col("stage") != "NO_INCIDENT").alias("no_false_all_clear"),
        F.col("stage").isin(*FINISHED).alias("reached_terminal"),
        cause_correct(F.col("cause_urn"), F.col("cause_field"), key).alias("root_cause_correct"),
    )


def checks_map(*names: str) -> Column:
    pairs = [x for n in names for x in (F.lit(n), F.col(n))]
    return F.create_map(*pairs)


def run_status(checks: Column, skipped: Column) -> Column:
    """passed when every check holds; error without checks; skipped on a failed precondition."""
    return (
        F.when(skipped, "skipped")
        .when(checks.isNull() | (F.size(checks) == 0), "error")
        .when(F.forall(F.map_values(checks), lambda v: v), "passed")
        .otherwise("failed")
    )


def consistency(results: DataFrame) -> DataFrame:
    """Trials, passes and pass rate per scenario."""
    return results.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("trials"),
        F.count_if(F.col("status") == "passed").alias("passed"),
    ).withColumn("pass_rate", round_to(safe_ratio(F.col("passed"), F.col("trials")), 4))
