"""Incident and run documents hold all that there is of an incident."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from driftlens.operators import grading as G
from driftlens.session import scratch_dir
from driftlens.sources import files as S
from driftlens.suite import files, ledger

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def test_every_evidence_item_is_written(spark):
    path = scratch_dir(spark, "evidence")
    files.write_evidence(spark, SF, path)
    got = S.read_incident_evidence(spark, path).select("incident_id", "id", "kind", "source", "title")
    want = ledger.graded_evidence(spark, SF).withColumn("incident_id", F.concat(F.lit("inc_"), "incident_id"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.count() > got.select("incident_id", "kind", "source").distinct().count()


def test_incident_documents_keep_their_fields(spark):
    path = scratch_dir(spark, "incidents")
    files.write_incidents(spark, SF, path)
    got = S.read_incidents(spark, path)
    assert got.filter("report_text is null or created_at is null").count() == 0
    assert got.filter("root_cause is not null and root_cause.detail is null").count() == 0
    assert got.count() == ledger.graded_incidents(spark, SF).count()


def test_run_documents_have_every_check(spark):
    path = scratch_dir(spark, "runs")
    files.write_eval_runs(spark, SF, path)
    runs = S.read_eval_runs(spark, path, one_per_file=False)
    names = {tuple(sorted(r.checks)) for r in runs.filter("checks is not null").collect()}
    assert names == {tuple(sorted(G.POSITIVE_CHECKS))}
    assert runs.filter("status in ('skipped', 'error') and checks is not null").count() == 0
