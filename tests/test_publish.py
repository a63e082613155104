"""A release becomes visible as a whole or not at all."""

import pytest
from pyspark.sql import functions as F

from driftlens.plans import revenue as R
from driftlens.session import scratch_dir
from driftlens.sources import publish
from test_revenue import inputs


def steps(spark, value, broken=False):
    def second(stored):
        if broken:
            raise RuntimeError("lost")
        return stored["first"].withColumn("twice", F.col("v") * 2)

    return {"first": lambda stored: spark.range(3).select(F.lit(value).alias("v")), "second": second}


def values(spark, root):
    found = publish.read(spark, root)
    return {name: sorted({r["v"] for r in df.collect()}) for name, df in found.items()}


def test_a_broken_run_leaves_the_old_release(spark):
    root = scratch_dir(spark, "publish")
    with pytest.raises(publish.NoRelease):
        publish.read(spark, root)
    assert publish.publish(spark, root, steps(spark, 1)) == 1
    assert values(spark, root) == {"first": [1], "second": [1]}
    with pytest.raises(RuntimeError):
        publish.publish(spark, root, steps(spark, 2, broken=True))
    # The first table of the broken run is stored, and no reader sees it.
    assert values(spark, root) == {"first": [1], "second": [1]}
    assert publish.publish(spark, root, steps(spark, 3)) == 2
    assert values(spark, root) == {"first": [3], "second": [3]}
    assert publish.read(spark, root)["second"].first()["twice"] == 6


def test_a_task_failure_in_between_leaves_the_old_release(spark):
    root = scratch_dir(spark, "publish")
    publish.publish(spark, root, steps(spark, 1))
    failing = steps(spark, 2) | {"second": lambda stored: stored["first"].select(F.raise_error(F.lit("lost")).cast("int").alias("v"))}
    with pytest.raises(Exception, match="lost"):
        publish.publish(spark, root, failing)
    assert values(spark, root) == {"first": [1], "second": [1]}


def test_readers_hold_on_to_their_release(spark):
    root = scratch_dir(spark, "publish")
    publish.publish(spark, root, steps(spark, 1))
    held = publish.read(spark, root)
    publish.publish(spark, root, steps(spark, 2))
    assert {r["v"] for r in held["first"].collect()} == {1} and publish.releases(spark, root).count() == 2


def test_layers_are_built_on_stored_layers(spark):
    root = scratch_dir(spark, "publish")
    raw, feed = inputs(spark)
    publish.publish(spark, root, R.layer_steps(raw, feed))
    stored, built = publish.read(spark, root), R.build(raw, feed)
    for name in ("stg_orders", "stg_fx_rates", "fct_revenue", "exec_revenue_metric"):
        assert sorted(map(str, stored[name].collect())) == sorted(map(str, getattr(built, name).collect()))


def test_variants_share_a_build(spark):
    raw, feed = inputs(spark)
    amounts = {"as_is": None, "half": F.col("amount") / 2}
    variants = R.build_variants(raw, feed, amounts)
    for name, amount in amounts.items():
        own = R.build(raw, feed, amount=amount)
        assert sorted(variants[name].fct_revenue.collect()) == sorted(own.fct_revenue.collect())
        assert variants[name].order_rows == own.order_rows
        assert sorted(map(str, variants[name].order_ledger().select(own.ledger.columns).collect())) == sorted(map(str, own.ledger.collect()))


def test_the_catalog_moves_no_text_twice(spark, sf):
    """Texts are dealt by urn once; tables without text or owners read neither."""
    from driftlens.operators import catalog as K
    from driftlens.suite import graph

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        steps = K.load_steps(graph.catalog_source(spark, sf), graph.edges_with_maps(spark, sf))
        assets = steps["assets"]({})
        moved = [line for line in plan(assets).splitlines() if "Exchange" in line]
        stored = {"assets": assets.select("urn")}
        tags = plan(steps["tags"](stored))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(moved) == 2  # documents and parts
    assert "n_name" not in tags and "s_name" not in tags and "text#" not in tags


def test_edges_are_distinct_pairs(spark, tmp_path):
    """Keys that come back and keys whose half is their third give each edge once."""
    from driftlens.suite import graph

    spark.createDataFrame([(k,) for k in (0, 1, 1, 2, 6, 6, -4, None)], "o_orderkey bigint").write.parquet(str(tmp_path / "orders.parquet"))
    got = [tuple(r) for r in graph.edges(spark, str(tmp_path)).select("source", "target").collect()]
    assert sorted(got) == [(0, 1), (0, 2), (1, 2), (2, 6), (3, 6)]
