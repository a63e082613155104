"""Column profiles per day and segment."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F, types as T

from driftlens.functions.numeric import round_to, safe_ratio
from driftlens.operators.quantiles import median_by

# Time columns tried in this order before any date-typed column.
TIME_COLUMNS = ("order_ts", "day", "date", "created_at", "rate_date", "rate_day")


def pick_time_column(df: DataFrame) -> str:
    for name in TIME_COLUMNS:
        if name in df.columns:
            return name
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return f.name
    raise ValueError(f"no time column among {df.columns}")


def recent(df: DataFrame, time_column: str, last_days: int) -> tuple[DataFrame, int]:
    """Rows of the last calendar days, counted back from the table's own last day.

    The cutoff is read first and then used as a literal on the stored column, so it
    reaches the scan and skips row groups. Also returns the table's row count.
    """
    row = df.agg(F.max(time_column).cast("date").alias("last"), F.count(F.lit(1)).alias("n")).first()
    if row["last"] is None:
        return df.filter(F.lit(False)), 0
    cutoff = row["last"] - dt.timedelta(days=last_days - 1)
    if not isinstance(df.schema[time_column].dataType, T.DateType):
        cutoff = dt.datetime.combine(cutoff, dt.time())
        return df.filter(F.col(time_column) >= F.lit(cutoff).cast("timestamp_ntz")), row["n"]
    return df.filter(F.col(time_column) >= F.lit(cutoff)), row["n"]


def profile_column(
    df: DataFrame,
    column: str,
    segment_by: str | None = None,
    last_days: int = 14,
    time_column: str | None = None,
) -> DataFrame:
    """n, mean, median, min, max and null rate per day and segment."""
    for name in (column, segment_by):
        if name is not None and name not in df.columns:
            raise ValueError(f"unknown column {name!r}")
    when = time_column or pick_time_column(df)
    rows, _ = recent(df, when, last_days)
    segment = F.lit("all") if segment_by is None else F.col(segment_by)
    shaped = rows.select(
        F.col(when).cast("date").alias("day"), segment.alias("segment"), F.col(column).alias("x")
    )
    out = median_by(shaped, ["day", "segment"], "x")
    values = {
        "mean": safe_ratio(F.col("total"), F.col("present")), "median": F.col("median"), "min": F.col("low"),
        "max": F.col("high"), "null_rate": _missing_share(),
    }
    return out.select("day", "segment", "n", *[round_to(v, 4).alias(c) for c, v in values.items()])


def _missing_share() -> Column:
    return 1 - F.col("present") / F.col("n")


def sorted_values(column: str) -> Column:
    """Sorted distinct non-null values; the input should already be distinct-ish."""
    return F.array_sort(F.collect_set(column))


def daily_profile(orders: DataFrame) -> DataFrame:
    """Per-day baseline profile of the amount, with the processors seen that day."""
    numbers = median_by(orders.select("order_day", "amount"), ["order_day"], "amount")
    values = {
        "amount_median": F.col("median"), "amount_mean": safe_ratio(F.col("total"), F.col("present")),
        "amount_min": F.col("low"), "amount_max": F.col("high"),
    }
    processors = (
        orders.select("order_day", "payment_processor").distinct()
        .groupBy("order_day").agg(sorted_values("payment_processor").alias("payment_processors"))
    )
    return numbers.join(processors, "order_day", "left").select(
        F.col("order_day").alias("day"),
        F.col("n").alias("row_count"),
        *[round_to(v, 2).alias(c) for c, v in values.items()],
        round_to(_missing_share(), 6).alias("amount_null_rate"),
        "payment_processors",
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n): every distinct value as a row, however many there are."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def _listed(values_of: str, values_name: str | None) -> list[Column]:
    """The sorted list of the values that a table of one row per value has, if it is asked for."""
    return [F.array_sort(F.collect_list(values_of)).alias(values_name)] if values_name else []


def table_profile(df: DataFrame, null_columns: list[str], values_of: str, values_name: str | None = None) -> DataFrame:
    """Row count, null rates and the distinct values of one column: their number and, named, their sorted list.

    Counting per value first is an aggregate that spills. The list is a part of the one row
    that the profile is; ``value_counts`` gives rows for a column with very many values.
    """
    per_value = df.groupBy(values_of).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in null_columns],
    )
    return per_value.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        *[F.try_divide(F.sum(f"null_{c}"), F.sum("n")).alias(f"{c}_null_rate") for c in null_columns],
        *_listed(values_of, values_name),
        F.count(values_of).alias("distinct_values"),
    )


def range_profile(df: DataFrame, column: str, values_of: str, values_name: str | None = None) -> DataFrame:
    """Table profile, with the list if it is named, plus the range of ``column``."""
    per_value = df.groupBy(values_of).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(column).isNull()).alias("nulls"),
        F.min(column).alias("lo"),
        F.max(column).alias("hi"),
    )
    return per_value.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.try_divide(F.sum("nulls"), F.sum("n")).alias(f"{column}_null_rate"),
        *_listed(values_of, values_name),
        F.count(values_of).alias("distinct_values"),
        round_to(F.min("lo"), 6).alias(f"{column}_min"),
        round_to(F.max("hi"), 6).alias(f"{column}_max"),
    )
