"""The bracketed median must equal a brute-force median, whatever the distribution."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from driftlens.operators import quantiles
from driftlens.operators.quantiles import median_by


def rows_of(kind: str, rng: random.Random):
    if kind == "hot_group":
        sizes = {"hot": 40_000, "a": 7, "b": 2, "c": 1}
        return [(k, rng.lognormvariate(3, 2)) for k, n in sizes.items() for _ in range(n)]
    if kind == "ties":
        return [(f"g{rng.randrange(5)}", float(rng.randrange(4))) for _ in range(20_000)]
    if kind == "two_scales":
        return [("x", rng.choice([1.0, 100.0]) * rng.random()) for _ in range(30_001)]
    if kind == "one_value":
        return [("x", 5.0)] * 1_000 + [("y", -0.0), ("y", 0.0)]
    if kind == "negative":
        return [(f"g{i % 3}", rng.gauss(0, 5)) for i in range(9_999)]
    return [
        (None if i % 4 == 0 else f"g{i % 3}", None if i % 5 == 0 else float(i % 11)) for i in range(1_000)
    ] + [("empty", None)] * 3


@pytest.mark.parametrize("kind", ["hot_group", "ties", "two_scales", "negative", "one_value", "nulls"])
@pytest.mark.parametrize("steps", [quantiles.STEPS, 0.25])
def test_median_equals_brute_force(spark, monkeypatch, kind, steps):
    # With four doublings to a bucket the range of the middle ranks holds most values.
    monkeypatch.setattr(quantiles, "STEPS", steps)
    data = rows_of(kind, random.Random(7))
    df = spark.createDataFrame(data, "k string, v double").repartition(6)
    got = {
        r["k"]: (r["n"], r["median"])
        for r in median_by(df, ["k"], "v").collect()
    }
    groups = {}
    for k, v in data:
        groups.setdefault(k, []).append(v)
    assert set(got) == set(groups)
    for k, values in groups.items():
        present = [v for v in values if v is not None]
        assert got[k][0] == len(values)
        if present:
            assert got[k][1] == pytest.approx(statistics.median(present), rel=1e-12)
        else:
            assert got[k][1] is None


def test_large_input_does_not_collect_groups(spark):
    """The plan holds no per-group value buffer."""
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v"))
    plan = median_by(df, ["k"], "v")._jdf.queryExecution().toString()
    assert "median(" not in plan.replace("_median(", "")


def test_buckets_keep_the_order(spark):
    """Across signs, magnitudes and the ends of the range of doubles."""
    rng = random.Random(3)
    values = [0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, float("inf"), float("-inf")]
    values += [rng.choice([-1, 1]) * 2.0 ** rng.uniform(-1070, 1020) for _ in range(3000)] + [rng.gauss(0, 1) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").withColumn("b", quantiles.bucket(F.col("v")))
    found = [r["b"] for r in df.orderBy("v").collect()]
    assert found == sorted(found) and len(set(found)) > 3000
    odd = spark.createDataFrame([(None,), (float("nan"),)], "v double").select(quantiles.bucket(F.col("v")).alias("b")).collect()
    assert {r["b"] for r in odd} == {None, 4 * quantiles.EXPONENTS * quantiles.STEPS}


def test_statistics_come_from_the_buckets(spark):
    rows = [("a", 2.0), ("a", 4.0), ("a", None), ("b", None), (None, -1.5)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r for r in median_by(df, ["k"], "v", {"big": F.when(F.col("v") > 3, 1).otherwise(0)}).collect()}
    assert [got["a"][c] for c in quantiles.STATS] == [3, 2, 6.0, 2.0, 4.0] and got["a"]["big"] == 1 and got["a"]["median"] == 3.0
    assert [got["b"][c] for c in quantiles.STATS] == [1, 0, None, None, None] and got["b"]["median"] is None
    assert got[None]["median"] == -1.5


def test_rows_are_scanned_twice(spark, tmp_path):
    """One scan counts buckets and is stored; what is left to do reads the rows once more."""
    path = str(tmp_path / "rows")
    spark.range(500).selectExpr("id % 3 AS k", "cast(id AS double) AS v").write.parquet(path)
    rows = spark.read.parquet(path)
    counted = quantiles.bucket_counts(rows, ["k"], "v")._jdf.queryExecution().executedPlan().toString()
    rest = median_by(rows, ["k"], "v")._jdf.queryExecution().executedPlan().toString()
    assert counted.count("FileScan") == 1 and rest.count(path[-20:]) == 1
