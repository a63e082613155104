"""Stage fold against a step-by-step replay, in batch and as a stream."""

import datetime as dt
import random

from driftlens.operators import incidents as I
from driftlens.session import scratch_dir
from driftlens.streaming import live

SCHEMA = "incident_id bigint, ts timestamp_ntz, event_id bigint, target_stage string"


def replay(events):
    """The rule itself, one event at a time."""
    stage = "REPORTED"
    for _, _, target in sorted(events):
        if target in I.EXITS:
            stage = target
        elif stage not in I.EXITS and I.STAGES.index(target) > I.STAGES.index(stage):
            stage = target
    return stage


def sample(seed=5, n=600):
    rng = random.Random(seed)
    start = dt.datetime(2026, 1, 1)
    rows = []
    for event_id in range(n):
        incident = 0 if rng.random() < 0.4 else rng.randrange(1, 40)
        exits = rng.random() < 0.05
        target = rng.choice(I.EXITS if exits else I.STAGES)
        rows.append((incident, start + dt.timedelta(seconds=rng.randrange(50)), event_id, target))
    return rows


def expected(rows):
    groups = {}
    for incident, ts, event_id, target in rows:
        groups.setdefault(incident, []).append((ts, event_id, target))
    return {k: replay(v) for k, v in groups.items()}


def test_fold_equals_replay(spark):
    rows = sample()
    got = {r["incident_id"]: r["stage"] for r in I.fold_stages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == expected(rows)


def test_fold_with_text_ids_and_equal_timestamps(spark):
    rows = [(i, ts, f"e{e:05d}", t) for i, ts, e, t in sample(11)]
    df = spark.createDataFrame(rows, SCHEMA.replace("event_id bigint", "event_id string"))
    assert {r["incident_id"]: r["stage"] for r in I.fold_stages(df).collect()} == expected(rows)


def test_fold_combines_without_sorting(spark):
    plan = I.fold_stages(spark.createDataFrame(sample(), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_stream_equals_batch_and_replayed_batches_change_nothing(spark):
    rows = sample(9)
    source, log = scratch_dir(spark, "events"), scratch_dir(spark, "log")
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(source)
    live.publish(live.live_stages(stream), log).awaitTermination()
    table = spark.read.parquet(log)
    assert {r["incident_id"]: r["stage"] for r in live.current_state(table).collect()} == expected(rows)
    last = table.agg({"batch_id": "max"}).first()[0]
    assert last >= 1
    # replay of the last batch: same rows, same state
    again = table.filter(f"batch_id = {last}").drop("batch_id")
    kept = again.collect()
    spark.createDataFrame(kept, again.schema).write.mode("overwrite").parquet(f"{log}/batch_id={last}")
    assert {r["incident_id"]: r["stage"] for r in live.current_state(spark.read.parquet(log)).collect()} == expected(rows)
    target = scratch_dir(spark, "compacted")
    live.compact(spark.read.parquet(log), target)
    assert {r["incident_id"]: r["stage"] for r in live.current_state(spark.read.parquet(target)).collect()} == expected(rows)


def test_terminal_class(spark):
    from pyspark.sql import functions as F

    rows = [("VERIFIED", True), ("NO_INCIDENT", True), ("ROOT_CAUSE_CONFIRMED", True), ("ROOT_CAUSE_CONFIRMED", False), ("REPORTED", False)]
    df = spark.createDataFrame(rows, "stage string, ok boolean")
    got = [r[0] for r in df.select(I.terminal_class(F.col("stage"), F.col("ok"))).collect()]
    assert got == ["VERIFIED", "NO_INCIDENT", "FAILED", "ROOT_CAUSE_CONFIRMED", "FAILED"]
