"""Live incident state with Structured Streaming.

The stage fold is a set of order-free aggregates, so the stream keeps them with the
built-in stateful aggregation: partial results combine before the shuffle and no
incident's events are gathered in Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from driftlens.operators.incidents import fold_aggregates, folded_stage
from driftlens.session import scratch_dir


def live_stages(events: DataFrame) -> DataFrame:
    """Streaming version of the fold: a full snapshot of each incident that changed."""
    return events.groupBy("incident_id").agg(*fold_aggregates(events)).select(
        "incident_id", folded_stage().alias("stage"), "events",
        F.col("_last").alias("updated_at"),
    )


RUN_ONCE = {"availableNow": True}


def publish(
    snapshots: DataFrame, path: str, checkpoint: str | None = None, trigger: dict | None = None
) -> StreamingQuery:
    """Append each micro-batch's snapshots to a change log under ``path``.

    A batch writes its own folder in overwrite mode: replaying it after a failure
    replaces the same rows instead of adding them again. ``trigger`` is what the stream
    writer takes, such as ``{"processingTime": "10 seconds"}`` for a feed that keeps
    running; without one, what is there is processed and the query ends. State beyond an
    executor's memory needs the RocksDB provider in ``spark.sql.streaming.stateStore.providerClass``.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    where = checkpoint or scratch_dir(snapshots.sparkSession, "live-checkpoint")
    return (
        snapshots.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", where)
        .trigger(**(trigger or RUN_ONCE))
        .start()
    )


def current_state(log: DataFrame) -> DataFrame:
    """Snapshot on connect: the newest row of every incident in the change log."""
    rest = [c for c in log.columns if c not in ("incident_id", "batch_id")]
    newest = log.groupBy("incident_id").agg(F.max_by(F.struct(*rest), "batch_id").alias("_s"))
    return newest.select("incident_id", *[F.col(f"_s.{c}").alias(c) for c in rest])


def changes_since(log: DataFrame, batch_id: int) -> DataFrame:
    """Snapshots a consumer has not seen; full rows, so missed steps do not matter."""
    return log.filter(F.col("batch_id") > batch_id)


def compact(log: DataFrame, path: str) -> None:
    """Rewrite the change log as one current snapshot in a new folder."""
    last = log.agg(F.max("batch_id").alias("b")).first()["b"]
    current_state(log).write.mode("overwrite").parquet(f"{path}/batch_id={last}")
