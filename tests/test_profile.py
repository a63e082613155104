"""A profile row holds the sorted values, not only their number."""

import __spark_entry__ as entry_point
from driftlens.operators import profile as P

SCHEMA = "customer_id bigint, segment string"


def test_table_profile_lists_the_values(spark):
    rows = [(1, "b"), (None, "a"), (3, "b"), (4, None)]
    row = P.table_profile(spark.createDataFrame(rows, SCHEMA), ["customer_id", "segment"], "segment", "segments").first()
    assert list(row["segments"]) == ["a", "b"] and row["distinct_values"] == 2
    assert (row["row_count"], row["customer_id_null_rate"], row["segment_null_rate"]) == (4, 0.25, 0.25)


def test_table_profile_of_no_rows_lists_nothing(spark):
    row = P.table_profile(spark.createDataFrame([], SCHEMA), ["segment"], "segment", "segments").first()
    assert row["row_count"] == 0 and list(row["segments"]) == [] and row["distinct_values"] == 0


def test_customers_are_profiled_with_their_segments(spark, sf):
    row = entry_point.queries()["A5_table_profile"](spark, sf).first()
    segments = row["segments"].split(",")
    assert segments == sorted(set(segments)) and len(segments) == row["distinct_values"] > 1


def test_range_profile_lists_the_values(spark):
    rows = [("EUR", 1.5), ("USD", None), (None, 0.5), ("EUR", 2.0)]
    row = P.range_profile(spark.createDataFrame(rows, "currency string, rate double"), "rate", "currency", "currencies").first()
    assert list(row["currencies"]) == ["EUR", "USD"] and row["distinct_values"] == 2
    assert (row["row_count"], row["rate_null_rate"], row["rate_min"], row["rate_max"]) == (4, 0.25, 0.5, 2.0)


def test_rates_are_profiled_with_their_currencies(spark, sf):
    assert entry_point.queries()["A6_range_profile"](spark, sf).first()["currencies"] == "CAD,EUR,GBP,USD"
