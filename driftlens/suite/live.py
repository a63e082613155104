"""Streaming queries; each must end in the same state as its batch counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from driftlens.session import scratch_dir
from driftlens.streaming import live
from driftlens.suite import inputs as fx
from driftlens.suite.ledger import STAGED, stage_events
from driftlens.suite.oracle import sql
from driftlens.suite.registry import query

def _event_stream(spark, sf) -> DataFrame:
    """Stage events as their table's files give them, read as a stream, a file per batch."""
    path = scratch_dir(spark, "stage-events")
    events = stage_events(spark, sf)
    events.write.parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _publish(spark, sf) -> str:
    path = scratch_dir(spark, "live-log")
    live.publish(live.live_stages(_event_stream(spark, sf)), path).awaitTermination()
    return path


@query("R1_live_incident_state", sql(STAGED, "SELECT incident_id, stage, events FROM folded"))
def live_incident_state(spark, sf):
    log = spark.read.parquet(_publish(spark, sf))
    return live.current_state(log).select("incident_id", "stage", "events")


@query(
    "R2_snapshot_then_changes",
    sql(STAGED, """SELECT f.incident_id, f.stage, e.updated_at FROM folded f JOIN
        (SELECT incident_id, max(ts) AS updated_at FROM stage_events GROUP BY 1) e ON f.incident_id = e.incident_id"""),
)
def snapshot_then_changes(spark, sf):
    """A consumer that took a snapshot after the first batch and then read the changes."""
    log = spark.read.parquet(_publish(spark, sf))
    compacted = scratch_dir(spark, "live-compacted")
    live.compact(log.filter("batch_id = 0"), compacted)
    snapshot = spark.read.parquet(compacted)
    later = live.changes_since(log, 0)
    return live.current_state(snapshot.unionByName(later)).select("incident_id", "stage", "updated_at")
