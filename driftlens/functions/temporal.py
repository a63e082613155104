"""UTC wall-clock casts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def utc_timestamp(df: DataFrame, column: str) -> Column:
    """``column`` as TIMESTAMP_NTZ in UTC.

    Strings keep their offset meaning ("…Z", "+02:00"), hence the step through the
    zoned type; the session must be pinned to UTC. A typed column is left alone so
    that filters on it still reach the scan.
    """
    kind = df.schema[column].dataType
    if isinstance(kind, T.TimestampNTZType):
        return F.col(column)
    return F.col(column).cast("timestamp").cast("timestamp_ntz")


def day_number(day: Column) -> Column:
    """Days since the epoch: an integer axis for RANGE frames."""
    return F.unix_date(day)
