"""Registered queries against their SQL twins; DRIFTLENS_ALL=1 runs every one."""

import datetime as dt
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from driftlens.suite import catalogue

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
SAMPLE = [
    "P1_staging_orders", "J7_unmatched_orders", "J9_asof_rate", "A1_daily_fact_bracketed", "A2_executive_kpi",
    "A3_column_profile", "W3_lagged_reference", "W5_onset", "Q_suite_incident", "B6_verify_repair",
    "F1_integer_share_bracketed", "F9_ratio_distribution", "L2_upstream_edges", "L4_edge_columns", "L7_shortest_path",
    "L11_estate_health", "E2_root_cause_gate", "E4_current_hypotheses", "E9_incident_records", "E12_scrub",
    "G1_positive_grade", "S6_transcript_scan", "R2_snapshot_then_changes", "U5_merge_first_seen",
]
NAMES = sorted(catalogue.QUERIES) if os.environ.get("DRIFTLENS_ALL") else SAMPLE


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    yield con
    con.close()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def test_every_query_has_a_twin():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, duck, name):
    df = entry_point.queries()[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    result = duck.execute(entry_point.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    want = result.fetchall()
    assert normal(df.columns, got) == normal(columns, want)


def test_entry(spark, sf):
    assert entry_point.entry(spark).columns == ["kpi_day", "revenue", "trailing_28d_median_revenue", "anomaly_ratio"]
