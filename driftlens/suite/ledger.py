"""Evidence ledger, gates, incident stages, grading.

Incidents are users and their facts events; graded incidents are orders with line
items as evidence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from driftlens.functions import numeric as N
from driftlens.operators import evidence as E, grading as G, incidents as I
from driftlens.suite import inputs as fx
from driftlens.suite.oracle import rnd, sql
from driftlens.session import materialize
from driftlens.suite.registry import query

MISSING = 1_000_000_000  # added to an id to cite a fact that does not exist

_KIND = (
    "case event_type when 'signup' then 'metadata' when 'view' then 'lineage' when 'purchase' then 'profile'"
    " when 'click' then 'baseline_comparison' else 'test' end"
)
_SOURCE = "case when event_type in ('signup', 'view') then 'metadata' when event_type in ('purchase', 'click') then 'warehouse' else 'pipeline' end"
_DATA = """case when event_type = 'signup' then replace(props, '{"k"', '{"via": "bridge", "k"') else props end"""
_ASSET = "case when user_id % 4 = 0 then 'urn:li:dataset:(urn:li:dataPlatform:duckdb,orders,PROD)' else 'urn:li:dataset:(urn:li:dataPlatform:duckdb,k,PROD)' end"
_FIELD = "case when user_id % 9 = 0 then '' else cast(user_id % 100 as {s}) end"
_CITES = (
    "value >= 40 and (user_id % 3 = 0 or (user_id % 3 = 1 and event_type in ('signup', 'view', 'error'))"
    " or (user_id % 3 = 2 and event_type in ('purchase', 'click', 'error')))"
)
_CITED_ID = f"case when value > 280 then event_id + {MISSING} else event_id end"
_HYP = "case when value > 200 then concat('none-', cast(event_id as {s})) else concat(cast(user_id as {s}), '-', event_type) end"
_UPDATE = "case event_id % 4 when 1 then 'eliminated' when 2 then 'confirmed' else 'investigating' end"
_UPDATE_CITED = f"case when value < 25 then event_id + {MISSING} else event_id end"

LEDGER = f"""
evidence AS (
  SELECT user_id AS incident_id, event_id AS evidence_id, ts, {_KIND} AS kind, {_SOURCE} AS source,
         event_type AS title, {_DATA} AS data FROM events),
claims AS (SELECT DISTINCT user_id AS claim_id, user_id AS incident_id, {_ASSET} AS asset_urn,
         {_FIELD.format(s='varchar')} AS field FROM events),
citations AS (SELECT user_id AS claim_id, user_id AS incident_id, {_CITED_ID} AS evidence_id FROM events WHERE {_CITES}),
traversed AS (SELECT DISTINCT user_id AS incident_id, {_ASSET} AS urn FROM events WHERE event_type = 'view' AND value > 120),
cited AS (SELECT c.*, e.kind, e.source, lower(e.data) AS data FROM citations c LEFT JOIN evidence e
          ON c.incident_id = e.incident_id AND c.evidence_id = e.evidence_id),
hypotheses AS (SELECT DISTINCT user_id AS incident_id, concat(cast(user_id AS varchar), '-', event_type) AS hypothesis_id,
         event_type AS target_urn FROM events),
updates AS (SELECT event_id AS update_id, user_id AS incident_id, {_HYP.format(s='varchar')} AS hypothesis_id, ts,
         {_UPDATE} AS status, value / 100 - 0.1 AS confidence FROM events),
update_citations AS (SELECT event_id AS update_id, user_id AS incident_id, {_UPDATE_CITED} AS evidence_id
         FROM events WHERE value >= 20),
judged AS (SELECT u.*, case when h.hypothesis_id IS NULL then 'unknown hypothesis'
         when u.status IN ('eliminated', 'confirmed') AND c.update_id IS NULL then 'evidence ids are required'
         when u.status IN ('eliminated', 'confirmed') AND e.evidence_id IS NULL then 'one or more evidence ids do not exist' end AS reason
         FROM updates u LEFT JOIN hypotheses h ON u.hypothesis_id = h.hypothesis_id
         LEFT JOIN update_citations c ON c.update_id = u.update_id
         LEFT JOIN evidence e ON e.incident_id = c.incident_id AND e.evidence_id = c.evidence_id),
current_hyp AS (SELECT h.incident_id, h.hypothesis_id, h.target_urn, coalesce(l.status, 'proposed') AS status,
         coalesce(l.confidence, 0.0::double) AS confidence FROM hypotheses h LEFT JOIN (
           SELECT hypothesis_id, arg_max(status, (ts, update_id)) AS status,
                  greatest(0, least(1, arg_max(confidence, (ts, update_id)))) AS confidence
           FROM judged WHERE reason IS NULL GROUP BY 1) l ON h.hypothesis_id = l.hypothesis_id)"""


def _events(spark, sf, **columns: str) -> DataFrame:
    return fx.table(spark, sf, "events").select(*[F.expr(v).alias(k) for k, v in columns.items()])


def evidence(spark, sf) -> DataFrame:
    return _events(
        spark, sf, incident_id="user_id", evidence_id="event_id", ts="ts", kind=_KIND, source=_SOURCE,
        title="event_type", data=_DATA, transport="cast(null as string)",
    )


def claims(spark, sf) -> DataFrame:
    return _events(
        spark, sf, claim_id="user_id", incident_id="user_id", asset_urn=_ASSET, field=_FIELD.format(s="string")
    ).distinct()


def citations(spark, sf) -> DataFrame:
    cited = fx.table(spark, sf, "events").filter(_CITES)
    return cited.select(
        F.col("user_id").alias("claim_id"), F.col("user_id").alias("incident_id"), F.expr(_CITED_ID).alias("evidence_id")
    )


def traversed(spark, sf) -> DataFrame:
    seen = fx.table(spark, sf, "events").filter("event_type = 'view' AND value > 120")
    return seen.select(F.col("user_id").alias("incident_id"), F.expr(_ASSET).alias("urn")).distinct()


def hypotheses(spark, sf) -> DataFrame:
    return _events(
        spark, sf, incident_id="user_id", hypothesis_id="concat(user_id, '-', event_type)", target_urn="event_type",
        status="'proposed'", confidence="0.0D",
    ).distinct()


def updates(spark, sf) -> DataFrame:
    return _events(
        spark, sf, update_id="event_id", incident_id="user_id", hypothesis_id=_HYP.format(s="string"), ts="ts",
        status=_UPDATE, confidence="value / 100 - 0.1D",
    )


def update_citations(spark, sf) -> DataFrame:
    return fx.table(spark, sf, "events").filter("value >= 20").select(
        F.col("event_id").alias("update_id"), F.col("user_id").alias("incident_id"),
        F.expr(_UPDATE_CITED).alias("evidence_id"), F.lit(0).alias("position"),
    )


def judged(spark, sf) -> DataFrame:
    return E.hypothesis_gate(
        updates(spark, sf), update_citations(spark, sf), evidence(spark, sf), hypotheses(spark, sf)
    )


# --- ledger -----------------------------------------------------------------------------

@query(
    "E1_ledger_append",
    sql(LEDGER, """SELECT incident_id, evidence_id, kind, source, case when evidence_id % 7 = 0 then 'manual' when data LIKE '%"via"%' then 'bridge'
        else case source when 'warehouse' then 'duckdb' when 'pipeline' then 'pytest' when 'git' then 'git'
        when 'agent' then 'agent' end end AS transport FROM evidence"""),
)
def ledger_append(spark, sf):
    """Half of the facts are in the ledger already; every seventh says its transport itself."""
    items = evidence(spark, sf).withColumn("transport", F.when(F.col("evidence_id") % 7 == 0, "manual").otherwise(F.col("transport")))
    ledger = materialize(E.resolve_transport(items.filter("evidence_id % 2 = 0")), "ledger")
    return E.append_items(ledger, items.filter("evidence_id % 2 <> 0")).select("incident_id", "evidence_id", "kind", "source", "transport")


@query(
    "J10_missing_citations",
    sql(LEDGER, "SELECT claim_id, incident_id, evidence_id FROM cited WHERE kind IS NULL"),
)
def missing_citations(spark, sf):
    return E.missing_citations(citations(spark, sf), evidence(spark, sf)).select("claim_id", "incident_id", "evidence_id")


def _gate_sql(strict: bool) -> str:
    extra = f"""case when NOT coalesce(meta, false) then '{E.NO_METADATA}' end,
        case when t.urn IS NULL then '{E.NOT_TRAVERSED}' end,""" if strict else ""
    return sql(LEDGER + """, facts AS (
        SELECT c.claim_id, count(*) FILTER (WHERE kind IS NULL) AS missing,
          bool_or(kind IN ('profile', 'baseline_comparison')) AS quant, bool_or(source IN ('datahub', 'metadata')) AS meta,
          bool_or(kind IN ('profile', 'baseline_comparison') AND contains(data, l.field)) AS has_field,
          bool_or(kind IN ('profile', 'baseline_comparison') AND contains(data, split_part(l.asset_urn, ',', 2))) AS has_asset
        FROM cited c JOIN claims l ON c.claim_id = l.claim_id GROUP BY 1),
      verdicts AS (SELECT l.claim_id, l.incident_id, l.asset_urn, case when missing > 0 then '""" + E.UNKNOWN_EVIDENCE + f"""'
        else concat_ws('; ', case when NOT coalesce(quant, false) then '{E.NO_QUANTITATIVE}' end, {extra}
          case when quant AND l.field <> '' AND NOT coalesce(has_field, false) then '{E.FIELD_MISSING}' end,
          case when quant AND l.field <> '' AND NOT coalesce(has_asset, false) then '{E.ASSET_MISSING}' end) end AS reasons
        FROM claims l LEFT JOIN facts f ON l.claim_id = f.claim_id
        LEFT JOIN traversed t ON t.incident_id = l.incident_id AND t.urn = l.asset_urn)""",
        "SELECT claim_id, reasons, reasons = '' AS accepted FROM verdicts")


def _gate(spark, sf, available: bool) -> DataFrame:
    verdicts = E.root_cause_gate(
        claims(spark, sf), citations(spark, sf), evidence(spark, sf), traversed(spark, sf), available
    )
    return verdicts.select("claim_id", F.array_join("reasons", "; ").alias("reasons"), "accepted")


@query("E2_root_cause_gate", _gate_sql(True))
def root_cause_gate(spark, sf):
    return _gate(spark, sf, True)


@query("E2_root_cause_gate_ablation", _gate_sql(False))
def root_cause_gate_ablation(spark, sf):
    return _gate(spark, sf, False)


_CLEARED = f"""cleared AS (SELECT l.claim_id, l.incident_id, case when f.claim_id IS NULL then '{E.NO_CITATIONS}'
    when missing > 0 then '{E.UNKNOWN_EVIDENCE}' when NOT quant then '{E.NO_QUANTITATIVE}' end AS reason FROM claims l LEFT JOIN (
      SELECT claim_id, count(*) FILTER (WHERE kind IS NULL) AS missing,
        coalesce(bool_or(kind IN ('profile', 'baseline_comparison')), false) AS quant FROM cited GROUP BY 1) f
    ON l.claim_id = f.claim_id)"""


@query("E3_no_incident_gate", sql(LEDGER + "," + _CLEARED, "SELECT claim_id, reason, reason IS NULL AS accepted FROM cleared"))
def no_incident_gate(spark, sf):
    verdicts = E.no_incident_gate(claims(spark, sf), citations(spark, sf), evidence(spark, sf))
    return verdicts.select("claim_id", "reason", "accepted")


_NODE_STATE = "case when max(value) > 200 then 'suspicious' when max(value) > 120 then 'investigating' when max(value) > 80 then 'affected' else 'healthy' end"


def incident_nodes(spark, sf) -> DataFrame:
    return fx.table(spark, sf, "events").groupBy(
        F.col("user_id").alias("incident_id"), F.col("event_type").alias("urn")
    ).agg(F.expr(_NODE_STATE).alias("status"))


_NODES = f"nodes AS (SELECT user_id AS incident_id, event_type AS urn, {_NODE_STATE} AS status FROM events GROUP BY 1, 2)"


@query(
    "E3_cleared_nodes",
    sql(LEDGER + "," + _CLEARED + "," + _NODES, """SELECT n.incident_id, n.urn, case when c.reason IS NULL
        AND n.status IN ('investigating', 'suspicious') then 'healthy' else n.status end AS status
        FROM nodes n JOIN cleared c ON n.incident_id = c.incident_id"""),
)
def cleared_nodes(spark, sf):
    verdicts = E.no_incident_gate(claims(spark, sf), citations(spark, sf), evidence(spark, sf))
    return E.clear_open_nodes(incident_nodes(spark, sf), verdicts).select("incident_id", "urn", "status")


@query("E4_hypothesis_gate", sql(LEDGER, "SELECT update_id, reason, reason IS NULL AS accepted FROM judged"))
def hypothesis_gate(spark, sf):
    return judged(spark, sf).select("update_id", "reason", "accepted")


@query(
    "E4_current_hypotheses",
    sql(LEDGER, f"SELECT hypothesis_id, target_urn, status, {rnd('confidence', 4)} AS confidence FROM current_hyp"),
)
def current_hypotheses(spark, sf):
    now = E.current_hypotheses(hypotheses(spark, sf), judged(spark, sf))
    return now.select("hypothesis_id", "target_urn", "status", N.round_to(F.col("confidence"), 4).alias("confidence"))


@query(
    "E5_node_status",
    sql(LEDGER + "," + _NODES, """SELECT n.incident_id, n.urn, case when h.live AND n.status IN ('healthy', 'investigating')
        then 'suspicious' when NOT h.live AND n.status IN ('suspicious', 'investigating') then 'healthy' else n.status end AS status
        FROM nodes n LEFT JOIN (SELECT incident_id, target_urn, bool_or(status <> 'eliminated') AS live FROM current_hyp
        GROUP BY 1, 2) h ON n.incident_id = h.incident_id AND n.urn = h.target_urn"""),
)
def node_status(spark, sf):
    now = E.current_hypotheses(hypotheses(spark, sf), judged(spark, sf))
    return E.node_status_from_hypotheses(incident_nodes(spark, sf), now).select("incident_id", "urn", "status")


@query(
    "E6_confirm_on_asset",
    sql(LEDGER, f"""SELECT hypothesis_id, case when hit then 'confirmed' else status end AS status,
        {rnd('case when hit then greatest(confidence, 0.95) else confidence end', 4)} AS confidence
        FROM (SELECT *, target_urn = 'click' AND status <> 'eliminated' AND incident_id IN
          (SELECT user_id FROM events GROUP BY 1 HAVING max(value) > 220) AS hit FROM current_hyp)"""),
)
def confirm_on_asset(spark, sf):
    now = E.current_hypotheses(hypotheses(spark, sf), judged(spark, sf))
    accepted = fx.table(spark, sf, "events").groupBy(F.col("user_id").alias("incident_id")).agg(
        F.lit("click").alias("asset_urn"), (F.max("value") > 220).alias("accepted")
    )
    return E.confirm_on_asset(now, accepted).select(
        "hypothesis_id", "status", N.round_to(F.col("confidence"), 4).alias("confidence")
    )


@query(
    "U6_merged_citations",
    sql(LEDGER, """SELECT j.incident_id, j.hypothesis_id, c.evidence_id, min(j.update_id) AS first_update
        FROM judged j JOIN update_citations c ON j.update_id = c.update_id WHERE j.reason IS NULL GROUP BY 1, 2, 3"""),
)
def merged_citations(spark, sf):
    merged = E.merged_citations(judged(spark, sf), update_citations(spark, sf))
    return merged.select("incident_id", "hypothesis_id", "evidence_id", F.col("first_cited.update_id").alias("first_update"))


@query(
    "U6_merge_id_lists",
    """SELECT l_orderkey, l_linenumber, concat_ws(',', l_partkey, case when l_suppkey <> l_partkey then l_suppkey end,
       case when l_linenumber <> l_suppkey and l_linenumber <> l_partkey then l_linenumber end) AS ids FROM lineitem""",
)
def merge_id_lists(spark, sf):
    ids = E.merge_ids(F.array("l_partkey", "l_suppkey"), F.array("l_suppkey", F.col("l_linenumber").cast("bigint")))
    return fx.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.concat_ws(",", ids.cast("array<string>")).alias("ids")
    )


@query("A10_evidence_census", sql(LEDGER, "SELECT source, count(*) AS n FROM evidence GROUP BY 1"))
def evidence_census(spark, sf):
    return E.census(evidence(spark, sf))


@query(
    "U4_required_kinds",
    sql(LEDGER, """SELECT claim_id, coalesce(bool_or(kind IN ('profile', 'baseline_comparison')), false) AS has_required
        FROM cited GROUP BY 1"""),
)
def required_kinds(spark, sf):
    return E.has_required_kind(citations(spark, sf), evidence(spark, sf))


@query("T4_timeline", sql(LEDGER, "SELECT incident_id, evidence_id, kind, title FROM evidence ORDER BY ts DESC, evidence_id DESC"))
def timeline(spark, sf):
    return E.timeline(evidence(spark, sf)).select("incident_id", "evidence_id", "kind", "title")


@query(
    "T5_ranked_hypotheses",
    sql(LEDGER, """SELECT hypothesis_id, status, case status when 'confirmed' then 1 when 'investigating' then 2
        when 'proposed' then 3 else 4 end::bigint AS rank FROM current_hyp"""),
)
def ranked_hypotheses(spark, sf):
    now = E.current_hypotheses(hypotheses(spark, sf), judged(spark, sf))
    return E.ranked_hypotheses(now).select("hypothesis_id", "status", "rank")


@query(
    "W6_evidence_digest",
    """SELECT user_id AS evidence_id, event_id AS position, event_type, cast(rank AS integer) AS rank FROM (
       SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank FROM events) WHERE rank <= 8""",
)
def evidence_digest(spark, sf):
    rows = _events(spark, sf, evidence_id="user_id", position="event_id", event_type="event_type")
    return E.digest(rows, 8)


# --- stages and records -----------------------------------------------------------------

_TARGET = """case when value > 150 then case when event_type = 'error' then 'FAILED' else 'NO_INCIDENT' end
    else case event_type when 'view' then 'CONTEXT_DISCOVERY' when 'click' then 'LINEAGE_TRAVERSAL'
      when 'signup' then case when value > 100 then 'REPAIR_TESTING' else 'HYPOTHESIS_GENERATION' end
      when 'purchase' then case when value > 60 then 'REPORTED' else 'EVIDENCE_COLLECTION' end
      else case when value > 120 then 'VERIFIED' else 'ROOT_CAUSE_CONFIRMED' end end end"""
_ORDINARY = ", ".join(f"'{s}'" for s in I.STAGES)
# Incidents of their own: a user's events of one hour, so that many never reach an exit.
_STAGE_KEY = "user_id * 1000 + {hour}"
STAGED = f"""
stage_events AS (SELECT {_STAGE_KEY.format(hour='date_diff(' + chr(39) + 'day' + chr(39) + ", timestamp '2024-01-01', ts)")} AS incident_id,
    ts, event_id, {_TARGET} AS target_stage FROM events),
folded AS (SELECT incident_id, coalesce(
    arg_max(target_stage, (ts, event_id)) FILTER (WHERE target_stage IN ('NO_INCIDENT', 'FAILED')),
    [{_ORDINARY}][max(list_position([{_ORDINARY}], target_stage))]) AS stage, count(*) AS events
  FROM stage_events GROUP BY 1)"""


def stage_events(spark, sf) -> DataFrame:
    return _events(
        spark, sf,
        incident_id=_STAGE_KEY.format(hour="datediff(cast(ts as date), date'2024-01-01')"),
        ts="ts", event_id="event_id", target_stage=_TARGET,
    )


@query("E7_stage_fold", sql(STAGED, "SELECT * FROM folded"))
def stage_fold(spark, sf):
    return I.fold_stages(stage_events(spark, sf))


@query(
    "E8_terminal_class",
    sql(STAGED, """SELECT incident_id, case when stage IN ('VERIFIED', 'WRITEBACK_COMPLETE', 'NO_INCIDENT') then stage
        when stage = 'ROOT_CAUSE_CONFIRMED' AND incident_id % 2 = 1 then stage else 'FAILED' end AS final_stage FROM folded"""),
)
def terminal_class(spark, sf):
    authorised = F.col("incident_id") % 2 == 0
    return I.fold_stages(stage_events(spark, sf)).select(
        "incident_id", I.terminal_class(F.col("stage"), authorised).alias("final_stage")
    )


def causes(spark, sf) -> DataFrame:
    return fx.table(spark, sf, "events").groupBy(F.col("user_id").alias("incident_id")).agg(
        F.lit("click").alias("asset_urn"), F.max("ts").alias("ts"),
        F.max_by("props", F.struct("ts", "event_id")).alias("summary"), F.max("value").alias("largest"),
    )


@query(
    "E9_incident_records",
    sql(_NODES + """, causes AS (SELECT user_id AS incident_id, arg_max(props, (ts, event_id)) AS summary,
          max(value) > 220 AS repaired FROM events GROUP BY 1),
        raised AS (SELECT DISTINCT incident_id, urn FROM (SELECT incident_id, 'click' AS urn FROM causes
          UNION ALL SELECT incident_id, urn FROM nodes WHERE status IN ('affected', 'root_cause')))""",
        """SELECT r.incident_id, r.urn, case when c.repaired then 'RESOLVED' else 'ACTIVE' end AS state,
           case when c.repaired then 'FIXED' else 'INVESTIGATION' end AS phase, c.summary AS title,
           'Root cause: ' || c.summary || chr(10) || 'Asset: ' || r.urn AS description,
           case when c.repaired then 'Verified repair of: ' || c.summary end AS message
           FROM raised r JOIN causes c ON r.incident_id = c.incident_id"""),
)
def incident_records(spark, sf):
    cause = causes(spark, sf)
    raised = I.raised_records(cause, incident_nodes(spark, sf))
    repaired = cause.filter(F.col("largest") > 220).select("incident_id", "ts")
    latest = I.upsert_latest(raised, I.resolved_records(raised, repaired), ["incident_id", "urn"], "ts")
    return latest.select("incident_id", "urn", "state", "phase", "title", "description", "message")


@query(
    "E9_writeback_status",
    """SELECT event_id, case when value > 50 AND event_type <> 'error' then 'complete' when value > 50 then 'partial'
       else 'pending' end AS status FROM events""",
)
def writeback_status(spark, sf):
    return fx.table(spark, sf, "events").select(
        "event_id",
        I.writeback_status(F.col("value") > 50, (F.col("value") > 50) & (F.col("event_type") != "error")).alias("status"),
    )


# --- graded incidents -------------------------------------------------------------------

_STAGE = (
    "case o_orderpriority when '1-URGENT' then 'VERIFIED' when '2-HIGH' then 'WRITEBACK_COMPLETE'"
    " when '3-MEDIUM' then 'NO_INCIDENT' when '4-NOT SPECIFIED' then 'ROOT_CAUSE_CONFIRMED' else 'FAILED' end"
)
_CAUSE = (
    "case o_custkey % 5 when 0 then 'urn:li:dataset:(urn:li:dataPlatform:duckdb,raw.raw_orders,PROD)'"
    " when 1 then 'urn:li:dataset:(urn:li:dataPlatform:duckdb,staging.stg_orders,PROD)'"
    " when 2 then 'urn:li:dataset:(urn:li:dataPlatform:duckdb,raw.raw_fx_rates,PROD)'"
    " when 4 then 'urn:li:dataset:(urn:li:dataPlatform:duckdb,marts.fct_revenue,PROD)' end"
)
_CAUSE_FIELD = "case when o_custkey % 5 = 3 then null when o_custkey % 3 <> 0 then 'amount' else 'usd_rate' end"
_SUMMARY = (
    "case when o_custkey % 5 = 3 then null else case o_orderkey % 4 when 0 then 'amounts switched to CENTS'"
    " when 1 then 'provider reports minor-units' when 2 then 'rows were duplicated' else 'values are 100× too high' end end"
)
_FILE = (
    "case o_orderkey % 6 when 0 then null when 1 then 'transforms/fct_revenue.sql'"
    " else 'transforms/stg_orders.sql' end"
)
_ADDED = (
    "case when o_orderkey % 6 = 0 then null else case o_custkey % 4 when 0 then '+ amount / 100'"
    " when 1 then '+ CASE WHEN PAYMENT_PROCESSOR = 1' else '+ WHERE provider_C' end end"
)
_FAILED = "case when o_custkey % 4 = 0 then 1 else 0 end"
_WB = "case when o_orderkey % 3 <> 0 then 'complete' else 'partial' end"
_WB_URN = "case when o_orderkey % 8 <> 0 then concat('urn:li:incident:', cast(o_orderkey as {s})) end"
_COLUMNS = {
    "incident_id": "o_orderkey", "stage": _STAGE, "created_at": "o_orderdate", "cause_urn": _CAUSE,
    "cause_field": _CAUSE_FIELD, "cause_summary": _SUMMARY, "cause_detail": "o_orderpriority", "patch_file": _FILE,
    "patch_added": _ADDED, "checks_failed": _FAILED, "checks_total": "32", "ratio_before": "o_totalprice / 3000",
    "ratio_after": "o_totalprice / 250000", "baseline_restored": "o_totalprice > 100000", "writeback_status": _WB,
}
_EV_KIND = "case l_linenumber % 4 when 0 then 'lineage' when 1 then 'profile' when 2 then 'baseline_comparison' else 'sql' end"
_EV_SOURCE = "case l_returnflag when 'A' then 'metadata' when 'N' then 'warehouse' else 'pipeline' end"
_EV_TITLE = "case when l_quantity > 45 then 'FX feed' else 'orders' end"
_EV_ID = "concat(cast(l_partkey as {s}), '/', cast(l_linenumber as {s}))"

GRADED = f"""
inc AS (SELECT {', '.join(f'{v} AS {k}' for k, v in _COLUMNS.items())}, {_WB_URN.format(s='varchar')} AS writeback_urn,
   o_orderkey % 10 = 0 AS two_files FROM orders),
ev AS (SELECT l_orderkey AS incident_id, {_EV_ID.format(s='varchar')} AS evidence_id, {_EV_KIND} AS kind,
   {_EV_SOURCE} AS source, {_EV_TITLE} AS title, l_discount >= 0.05 AS cited FROM lineitem),
facts AS (SELECT incident_id, bool_or(source IN ('metadata', 'datahub') AND kind = 'lineage') AS catalog_lineage,
   bool_or(any_cited AND kind IN ('profile', 'baseline_comparison')) AS cited_quantitative,
   bool_or(contains(lower(title), 'fx')) AS distractor_examined, count(*) AS evidence_items
   FROM (SELECT *, bool_or(cited) OVER (PARTITION BY incident_id, evidence_id) AS any_cited FROM ev) GROUP BY 1),
positive AS (SELECT i.incident_id,
   stage IN ('VERIFIED', 'WRITEBACK_COMPLETE') AS terminal_ok,
   coalesce((cause_urn LIKE '%raw.raw_orders,PROD)' OR cause_urn LIKE '%staging.stg_orders,PROD)') AND cause_field = 'amount', false)
     AS root_cause_correct,
   cause_urn IS NOT NULL AND regexp_matches(concat_ws(' ', cause_summary, cause_detail),
     '(cent|minor.?unit|100(x|×)|scal(e|ing)|unit)', 'i') AS semantic_identified,
   NOT coalesce(contains(cause_urn, 'raw_fx_rates'), false) AS distractor_avoided,
   coalesce(patch_file = 'transforms/stg_orders.sql', false) AS repair_correct_file,
   coalesce(checks_failed = 0 AND checks_total >= 30 AND ratio_after BETWEEN 0.8 AND 1.3, false) AS repair_verified,
   coalesce(contains(lower(patch_added), 'provider_c') OR contains(lower(patch_added), 'payment_processor'), false) AS repair_targeted,
   baseline_restored AS repair_restores_baseline,
   patch_file IS NULL OR (patch_file = 'transforms/stg_orders.sql' AND NOT two_files) AS repair_single_file,
   coalesce(catalog_lineage AND cited_quantitative, false) AS evidence_coverage,
   coalesce(writeback_status = 'complete' AND writeback_urn IS NOT NULL, false) AS writeback_done,
   coalesce(cause_urn LIKE '%raw.raw_orders,PROD)', false) AS blamed_most_upstream,
   coalesce(distractor_examined, false) AS distractor_examined
   FROM inc i LEFT JOIN facts f ON i.incident_id = f.incident_id)"""


def graded_incidents(spark, sf) -> DataFrame:
    changed = (
        F.when(F.col("patch_file").isNull(), F.array().cast("array<string>"))
        .when(F.col("incident_id") % 10 == 0, F.array(F.col("patch_file"), F.lit("transforms/other.sql")))
        .otherwise(F.array("patch_file"))
    )
    return fx.table(spark, sf, "orders").select(
        *[F.expr(v).alias(k) for k, v in _COLUMNS.items()], F.expr(_WB_URN.format(s="string")).alias("writeback_urn")
    ).withColumn("changed_files", changed)


def graded_evidence(spark, sf) -> DataFrame:
    return fx.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("incident_id"), F.expr(_EV_ID.format(s="string")).alias("evidence_id"),
        F.expr(_EV_KIND).alias("kind"), F.expr(_EV_SOURCE).alias("source"), F.expr(_EV_TITLE).alias("title"),
    )


def graded_citations(spark, sf) -> DataFrame:
    return fx.table(spark, sf, "lineitem").filter("l_discount >= 0.05D").select(
        F.col("l_orderkey").alias("incident_id"), F.expr(_EV_ID.format(s="string")).alias("evidence_id")
    )


KEY = G.AnswerKey(
    origin_suffix="raw.raw_orders,PROD)",
    accepted_suffixes=("raw.raw_orders,PROD)", "staging.stg_orders,PROD)"),
    field="amount",
    repair_file="transforms/stg_orders.sql",
    distractor="raw_fx_rates",
    cohort_words=(fx.COHORT, "payment_processor"),
)


def positive_grades(spark, sf) -> DataFrame:
    facts = G.evidence_facts(graded_evidence(spark, sf), graded_citations(spark, sf))
    return G.grade_positive(graded_incidents(spark, sf), facts, KEY)


@query("G1_positive_grade", sql(GRADED, "SELECT * FROM positive"))
def positive_grade(spark, sf):
    return positive_grades(spark, sf)


@query("G2_root_cause_grade", sql(GRADED, "SELECT incident_id, root_cause_correct, blamed_most_upstream FROM positive"))
def root_cause_grade(spark, sf):
    return graded_incidents(spark, sf).select(
        "incident_id",
        G.cause_correct(F.col("cause_urn"), F.col("cause_field"), KEY).alias("root_cause_correct"),
        G.blamed_origin(F.col("cause_urn"), KEY).alias("blamed_most_upstream"),
    )


@query(
    "G3_control_grade",
    sql(GRADED, """SELECT incident_id, stage = 'NO_INCIDENT' AS stage_no_incident, patch_file IS NULL AS no_patch,
        patch_file IS NULL AS transforms_unchanged, cause_urn IS NULL AS no_false_positive FROM inc"""),
)
def control_grade(spark, sf):
    return G.grade_control(graded_incidents(spark, sf))


_STATS = """stats AS (SELECT conv_id AS incident_id, count(*) FILTER (WHERE role = 'assistant') AS turns,
    count(*) FILTER (WHERE role = 'user') AS tool_calls FROM conversations GROUP BY 1)"""


def transcripts(spark, sf) -> DataFrame:
    return fx.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("incident_id"), "turn",
        F.expr("if(role = 'assistant', 'tool_use', null)").alias("stop_reason"),
        F.expr("if(role = 'user', 'run_sql', null)").alias("tool_result_for"),
    )


@query("A11_transcript_stats", sql(_STATS, "SELECT * FROM stats"))
def transcript_stats(spark, sf):
    return G.transcript_stats(transcripts(spark, sf))


@query(
    "G4_ablation_grade",
    sql(GRADED + "," + _STATS, """SELECT i.incident_id, coalesce(turns, 0) > 0 AS run_executed, stage <> 'NO_INCIDENT' AS no_false_all_clear,
        stage IN ('VERIFIED', 'WRITEBACK_COMPLETE') AS reached_terminal, p.root_cause_correct
        FROM inc i JOIN positive p ON i.incident_id = p.incident_id LEFT JOIN stats s ON i.incident_id = s.incident_id"""),
)
def ablation_grade(spark, sf):
    return G.grade_ablation(graded_incidents(spark, sf), G.transcript_stats(transcripts(spark, sf)), KEY)


_ALL = " AND ".join(G.POSITIVE_CHECKS)
_RUN = f"""runs AS (SELECT p.incident_id, o_orderpriority AS scenario, case when o_totalprice > 490000 then 'skipped'
    when o_orderstatus = 'P' then 'error' when {_ALL} then 'passed' else 'failed' end AS status
    FROM positive p JOIN orders ON o_orderkey = p.incident_id)"""


def checked_runs(spark, sf) -> DataFrame:
    """Runs with their checks, which those that were skipped or broke off have not."""
    orders = fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("incident_id"), F.col("o_orderpriority").alias("scenario"),
        (F.col("o_totalprice") > 490000).alias("skipped"), (F.col("o_orderstatus") == "P").alias("broken"),
    )
    graded = positive_grades(spark, sf).join(orders, "incident_id")
    checks = F.when(~F.col("broken"), G.checks_map(*G.POSITIVE_CHECKS))
    return graded.select(
        "incident_id", "scenario", G.run_status(checks, F.col("skipped")).alias("status"),
        F.when(~F.col("skipped"), checks).alias("checks"),
    )


def run_results(spark, sf) -> DataFrame:
    return checked_runs(spark, sf).drop("checks")


@query("G5_run_status", sql(GRADED + "," + _RUN, "SELECT * FROM runs"))
def run_status(spark, sf):
    return run_results(spark, sf)


@query(
    "A12_trial_consistency",
    sql(GRADED + "," + _RUN, f"""SELECT scenario, count(*) AS trials, count(*) FILTER (WHERE status = 'passed') AS passed,
        {rnd("count(*) FILTER (WHERE status = 'passed') / count(*)", 4)} AS pass_rate FROM runs GROUP BY 1"""),
)
def trial_consistency(spark, sf):
    return G.consistency(run_results(spark, sf))


@query(
    "A16_outcome_rollup",
    sql(GRADED, f"""SELECT i.incident_id, stage, cause_urn IS NOT NULL AS root_cause_confirmed, coalesce(evidence_items, 0) AS evidence_items,
        coalesce(h.n, 0) AS hypotheses, c.ok || '/' || c.total AS checks, c.ok = c.total AS all_passed,
        {rnd('ratio_before', 4)} AS ratio_before, {rnd('ratio_after', 4)} AS ratio_after
        FROM inc i LEFT JOIN facts f ON i.incident_id = f.incident_id
        LEFT JOIN (SELECT user_id, count(DISTINCT event_type) AS n FROM events GROUP BY 1) h ON h.user_id = i.incident_id
        LEFT JOIN (SELECT l_orderkey, count(*) FILTER (WHERE l_tax < 0.08) AS ok, count(*) AS total FROM lineitem GROUP BY 1) c
          ON c.l_orderkey = i.incident_id"""),
)
def outcome_rollup(spark, sf):
    incidents = graded_incidents(spark, sf).withColumnRenamed("cause_urn", "root_cause_urn")
    checks = fx.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("incident_id"), (F.col("l_tax") < 0.08).alias("passed")
    )
    return I.outcome_rollup(incidents, graded_evidence(spark, sf), hypotheses(spark, sf), checks)


@query(
    "W7_latest_incident",
    sql(GRADED, "SELECT incident_id, stage, cause_urn FROM inc ORDER BY created_at DESC, incident_id DESC LIMIT 1"),
)
def latest_incident(spark, sf):
    return I.latest_incident(graded_incidents(spark, sf)).select("incident_id", "stage", "cause_urn")


@query("S11_clear_incidents", sql(GRADED, "SELECT incident_id, stage FROM inc WHERE stage <> 'FAILED'"))
def clear_incidents(spark, sf):
    """The incident set after clearing every failed incident."""
    incidents = graded_incidents(spark, sf)
    return I.without(incidents, incidents.filter(F.col("stage") == "FAILED")).select("incident_id", "stage")


@query("T6_incident_list", sql(GRADED, "SELECT incident_id, stage, cause_detail AS report_text, cast(created_at AS date) AS created_day FROM inc"))
def incident_list(spark, sf):
    listed = I.incident_list(graded_incidents(spark, sf).withColumnRenamed("cause_detail", "report_text"))
    return listed.select("incident_id", "stage", "report_text", F.to_date("created_at").alias("created_day"))
