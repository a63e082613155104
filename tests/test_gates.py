"""Truth table of the acceptance gates."""

import datetime as dt

import pytest

from driftlens.operators import evidence as E, lineage as L

RAW = "urn:li:dataset:(urn:li:dataPlatform:duckdb,raw.raw_orders,PROD)"
STG = "urn:li:dataset:(urn:li:dataPlatform:duckdb,staging.stg_orders,PROD)"
FCT = "urn:li:dataset:(urn:li:dataPlatform:duckdb,marts.fct_revenue,PROD)"
EVIDENCE = [
    ("i", "meta", "lineage", "metadata", None),
    ("i", "good", "profile", "warehouse", '{"table": "raw.raw_orders", "column": "AMOUNT"}'),
    ("i", "other", "profile", "warehouse", '{"table": "raw.raw_orders", "column": "usd_rate"}'),
    ("i", "elsewhere", "profile", "warehouse", '{"table": "marts.fct_revenue", "column": "amount"}'),
    ("i", "empty", "baseline_comparison", "warehouse", None),
    ("j", "foreign", "profile", "warehouse", '{"table": "raw.raw_orders", "column": "amount"}'),
]
CASES = {
    "accepted": (RAW, "amount", ["meta", "good"], []),
    "nothing cited": (RAW, "amount", [], [E.NO_QUANTITATIVE, E.NO_METADATA]),
    "no numbers": (RAW, "amount", ["meta"], [E.NO_QUANTITATIVE]),
    "no metadata": (RAW, "amount", ["good"], [E.NO_METADATA]),
    "wrong field": (RAW, "amount", ["meta", "other"], [E.FIELD_MISSING]),
    "wrong asset": (RAW, "amount", ["meta", "elsewhere"], [E.ASSET_MISSING]),
    "field and asset from different facts": (RAW, "amount", ["meta", "other", "elsewhere"], []),
    "untraversed": ("urn:x", "", ["meta", "good"], [E.NOT_TRAVERSED]),
    "empty field skips the text match": (RAW, "", ["meta", "empty"], []),
    "empty payload": (RAW, "amount", ["meta", "empty"], [E.FIELD_MISSING, E.ASSET_MISSING]),
    "unknown id alone": (RAW, "amount", ["meta", "nope"], [E.UNKNOWN_EVIDENCE]),
    "another incident's fact": (RAW, "amount", ["meta", "foreign"], [E.UNKNOWN_EVIDENCE]),
}


@pytest.fixture(scope="module")
def ledger(spark):
    evidence = spark.createDataFrame(EVIDENCE, "incident_id string, evidence_id string, kind string, source string, data string")
    claims = spark.createDataFrame(
        [(k, "i", urn, field) for k, (urn, field, _, _) in CASES.items()],
        "claim_id string, incident_id string, asset_urn string, field string",
    )
    citations = spark.createDataFrame(
        [(k, "i", c) for k, (_, _, cited, _) in CASES.items() for c in cited],
        "claim_id string, incident_id string, evidence_id string",
    )
    nodes = spark.createDataFrame([("i", u) for u in (RAW, STG, FCT)], "incident_id string, urn string")
    return claims, citations, evidence, nodes


def test_root_cause_gate(ledger):
    got = {r["claim_id"]: r for r in E.root_cause_gate(*ledger).collect()}
    for name, (_, _, _, reasons) in CASES.items():
        assert list(got[name]["reasons"]) == reasons, name
        assert got[name]["accepted"] == (not reasons)


def test_root_cause_gate_without_metadata_service(ledger):
    got = {r["claim_id"]: list(r["reasons"]) for r in E.root_cause_gate(*ledger, metadata_available=False).collect()}
    assert got["no metadata"] == [] and got["untraversed"] == []
    assert got["nothing cited"] == [E.NO_QUANTITATIVE]
    assert got["wrong field"] == [E.FIELD_MISSING]


def test_no_incident_gate(ledger):
    claims, citations, evidence, _ = ledger
    got = {r["claim_id"]: r["reason"] for r in E.no_incident_gate(claims, citations, evidence).collect()}
    assert got["nothing cited"] == E.NO_CITATIONS
    assert got["no numbers"] == E.NO_QUANTITATIVE
    assert got["unknown id alone"] == E.UNKNOWN_EVIDENCE
    assert got["no metadata"] is None


def test_hypothesis_updates(spark, ledger):
    evidence = ledger[2]
    t = [dt.datetime(2026, 1, 1, h) for h in range(6)]
    hyps = spark.createDataFrame(
        [("i", "h1", FCT, "proposed", 0.0), ("i", "h2", FCT, "proposed", 0.0)],
        "incident_id string, hypothesis_id string, target_urn string, status string, confidence double",
    )
    updates = spark.createDataFrame(
        [
            ("u1", "i", "h1", t[0], "investigating", 1.7),
            ("u2", "i", "h1", t[1], "eliminated", 0.1),  # cites nothing
            ("u3", "i", "h1", t[2], "eliminated", -3.0),
            ("u4", "i", "h2", t[3], "confirmed", 0.8),  # unknown id
            ("u5", "i", "zz", t[4], "investigating", 0.5),
        ],
        "update_id string, incident_id string, hypothesis_id string, ts timestamp_ntz, status string, confidence double",
    )
    cites = spark.createDataFrame(
        [("u1", "i", "good", 0), ("u3", "i", "meta", 0), ("u3", "i", "good", 1), ("u4", "i", "nope", 0)],
        "update_id string, incident_id string, evidence_id string, position int",
    )
    judged = E.hypothesis_gate(updates, cites, evidence, hyps)
    reasons = {r["update_id"]: r["reason"] for r in judged.collect()}
    assert reasons == {"u1": None, "u2": E.NO_CITATIONS, "u3": None, "u4": E.UNKNOWN_EVIDENCE, "u5": E.UNKNOWN_HYPOTHESIS}
    now = E.current_hypotheses(hyps, judged)
    state = {r["hypothesis_id"]: (r["status"], r["confidence"]) for r in now.collect()}
    assert state == {"h1": ("eliminated", 0.0), "h2": ("proposed", 0.0)}
    merged = E.merged_citations(judged, cites).orderBy("first_cited").collect()
    assert [r["evidence_id"] for r in merged] == ["good", "meta"]  # first citation wins
    nodes = spark.createDataFrame([("i", FCT, "investigating"), ("i", STG, "healthy")], "incident_id string, urn string, status string")
    status = {r["urn"]: r["status"] for r in E.node_status_from_hypotheses(nodes, now).collect()}
    assert status == {FCT: "suspicious", STG: "healthy"}  # h2 is still live
    both = now.withColumn("status", E.F.lit("eliminated"))
    status = {r["urn"]: r["status"] for r in E.node_status_from_hypotheses(nodes, both).collect()}
    assert status[FCT] == "healthy"


def test_confirmation_marks_the_graph(spark):
    nodes = spark.createDataFrame([(RAW, "investigating"), (STG, "suspicious"), (FCT, "repaired")], "urn string, status string")
    edges = spark.createDataFrame([(RAW, STG), (STG, FCT)], "source string, target string")
    after = {r["urn"]: r["status"] for r in L.propagate_status(nodes, edges, RAW).collect()}
    assert after == {RAW: "root_cause", STG: "affected", FCT: "repaired"}
    confirmed = spark.createDataFrame(list(after.items()), "urn string, status string")
    fixed = {r["urn"]: r["status"] for r in L.propagate_status(confirmed, edges, RAW, verified=True).collect()}
    assert fixed == {RAW: "repaired", STG: "healthy", FCT: "repaired"}


def test_transport_resolution(spark):
    items = spark.createDataFrame(
        [("a", "warehouse", None, "{}"), ("b", "metadata", '{"via": "x"}', None), ("c", "metadata", "{}", None), ("d", "git", '{"via": "y"}', "z")],
        "evidence_id string, source string, data string, transport string",
    )
    got = {r["evidence_id"]: r["transport"] for r in E.resolve_transport(items).collect()}
    assert got == {"a": "{}", "b": "x", "c": None, "d": "z"}


def test_schema_changes_sort_unmerged_parts(spark, sf):
    """What a task sorts is the table over the session's parts, not what compresses to one merged part."""
    from driftlens.suite import catalogue

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalogue.QUERIES["L14_schema_changes"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("REPARTITION_BY_NUM") == 4 and "ENSURE_REQUIREMENTS" not in plan
