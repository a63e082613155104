"""Connected components of a large graph by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from driftlens.llm.common import materialize

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node points its larger neighbours to its smallest one."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both, "cc-both")
    low = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("at"), F.least("a", "low").alias("low"))
    low = materialize(low, "cc-low")
    return both.join(low, both.a == low["at"]).filter("b > a").select("low", F.col("b").alias("b")).withColumnRenamed("low", "a").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node points its smaller neighbours, and itself, to the smallest; edges have a < b."""
    low = materialize(edges.groupBy("b").agg(F.min("a").alias("low")).withColumnRenamed("b", "at"), "cc-low")
    joined = edges.join(low, edges.b == low["at"])
    down = joined.filter("a > low").select(F.col("low").alias("a"), F.col("a").alias("b"))
    return down.unionByName(low.select(F.col("low").alias("a"), F.col("at").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b) but the roots; a root is its component's least node.

    Every round is stored, so plans stay short and lost executors cost one round at most.
    """
    ordered = edges.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    current = materialize(ordered.distinct(), "cc-edges")
    if not current.limit(1).count():
        return current.select(F.col("b").alias("node"), F.col("a").alias("root"))
    state = _digest(current)
    for _ in range(MAX_ROUNDS):
        current = materialize(_small_star(materialize(_large_star(current), "cc-large")), "cc-small")
        now = _digest(current)
        if now == state:
            return current.select(F.col("b").alias("node"), F.col("a").alias("root"))
        state = now
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())
