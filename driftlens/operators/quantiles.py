"""Exact grouped medians in two scans that never bring one group into one task.

``median()`` keeps every distinct value of a group in one buffer, which fails when a
single day holds a third of the table. Here the first scan counts values in logarithmic
buckets: their number depends on the spread of the values alone, and they combine on the
map side. A bucket keeps its count, sum, least and largest value, so counts, means and
ranges come from it as well. The buckets give each group a range that holds its middle
ranks: the value of a rank lies between what the rank finds among the buckets' least and
among their largest values. The second scan counts what lies below that range and ranks
only the distinct values inside. The result is exact, not an estimate: buckets only decide
which values are worth ranking. There is this one path for every size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from driftlens.operators.joins import null_safe
from driftlens.session import materialize

# Buckets for each doubling of the absolute value: a bucket spans 0.5 % of its values.
STEPS = 128
# Binary exponents of doubles lie within this distance of zero.
EXPONENTS = 1100

LOW_RANK, HIGH_RANK = "(_n - 1) div 2", "_n div 2"
STATS = ["n", "present", "total", "low", "high"]


def bucket(value: Column) -> Column:
    """Number of the value's bucket; it never decreases as the value grows. NULL for NULL."""
    size = F.least(F.floor(F.log2(F.abs(value)) * STEPS), F.lit(EXPONENTS * STEPS - 1)) + EXPONENTS * STEPS
    return (
        F.when(F.isnan(value), 4 * EXPONENTS * STEPS)
        .when(value > 0, size)
        .when(value < 0, -size)
        .when(value == 0, 0)
        .cast("long")
    )


def bucket_counts(df: DataFrame, keys: Sequence[str], value: str, sums: Mapping[str, Column] | None = None) -> DataFrame:
    """``keys``, ``bucket`` and its n, total, low, high and further ``sums`` over rows."""
    rows = df.withColumn("_v", F.col(value).cast("double"))
    return rows.groupBy(*keys, bucket(F.col("_v")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_v").alias("total"), F.min("_v").alias("low"), F.max("_v").alias("high"),
        *[F.sum(expr).alias(name) for name, expr in (sums or {}).items()],
    )


def _running(counts: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """``_end``: rows of the group up to and including this one."""
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumn("_end", F.sum("_c").over(upto))


def _covers(rank: str) -> str:
    return f"(_end - _c <= {rank} AND {rank} < _end)"


def summary(buckets: DataFrame, keys: Sequence[str], sums: Sequence[str] = ()) -> DataFrame:
    """Each group's n, present, total, low, high, ``sums`` and the range ``_lo`` to ``_hi`` of its middle ranks.

    Buckets of a group may overlap, as those of several currencies do once they are priced.
    """
    known = F.col("low").isNotNull()
    counted = buckets.withColumn("_c", F.when(known, F.col("n")).otherwise(0))
    counted = counted.withColumn("_n", F.sum("_c").over(Window.partitionBy(*keys)))
    from_low = _running(counted, keys, "low", "bucket").withColumn("_is_low", F.expr(f"{_covers(LOW_RANK)}"))
    from_high = _running(from_low, keys, "high", "bucket").withColumn("_is_high", F.expr(f"{_covers(HIGH_RANK)}"))
    return from_high.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("_c").alias("present"), F.sum("total").alias("total"),
        F.min("low").alias("low"), F.max("high").alias("high"), *[F.sum(c).alias(c) for c in sums],
        F.min(F.when(F.col("_is_low") & known, F.col("low"))).alias("_lo"),
        F.max(F.when(F.col("_is_high") & known, F.col("high"))).alias("_hi"),
    )


def middle(rows: DataFrame, groups: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """``groups``, a stored ``summary``, with the interpolated median of ``value`` over ``rows``."""
    keys = list(keys)
    theirs = [f"_key{i}" for i in range(len(keys))]
    ranges = groups.select(*[F.col(k).alias(t) for k, t in zip(keys, theirs)], F.col("present").alias("_n"), "_lo", "_hi")
    slim = rows.select(*keys, F.col(value).cast("double").alias("_v"))
    inside = F.col("_v") >= F.col("_lo")
    counts = (
        slim.join(ranges, null_safe(keys, theirs) & (F.col("_v") <= F.col("_hi")))
        .groupBy(*keys, "_n", inside.alias("_inside"), F.when(inside, F.col("_v")).alias("_x"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    low, high = (F.expr(f"max(if({_covers(r)}, _x, null))") for r in (LOW_RANK, HIGH_RANK))
    found = _running(counts, keys, "_inside", "_x").groupBy(*keys).agg(low.alias("_a"), high.alias("_b"))
    found = found.withColumnsRenamed(dict(zip(keys, theirs)))
    return groups.join(found, null_safe(keys, theirs), "left").select(
        *[c for c in groups.columns if c not in ("_lo", "_hi")], F.expr("(_a + _b) / 2").alias(name)
    )


def median_by(
    df: DataFrame, keys: Sequence[str], value: str, sums: Mapping[str, Column] | None = None, name: str = "median"
) -> DataFrame:
    """``keys``, STATS, the ``sums`` over rows and the interpolated median of ``value``.

    The per-group summary is written once: Catalyst then knows its bytes and picks the join,
    and its sums stay fixed if a shuffled task has to run again.
    """
    groups = materialize(summary(bucket_counts(df, keys, value, sums), keys, list(sums or {})), "median-summary")
    return middle(df, groups, keys, value, name)
