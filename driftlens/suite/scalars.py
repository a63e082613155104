"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftlens.functions import numeric as N
from driftlens.functions.temporal import utc_timestamp
from driftlens.suite import inputs as fx
from driftlens.suite.oracle import rnd
from driftlens.suite.registry import query

_WIRE = "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ')"


@query(
    "X1_typed_casts",
    f"""SELECT o_orderkey, cast({_WIRE} AS timestamp) AS order_ts, cast(cast({_WIRE} AS timestamp) AS date) AS order_day,
        cast(cast(o_totalprice AS varchar) AS double) AS amount FROM orders""",
)
def typed_casts(spark, sf):
    wire = fx.table(spark, sf, "orders").select(
        "o_orderkey",
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("order_ts"),
        F.col("o_totalprice").cast("string").alias("amount"),
    )
    ts = utc_timestamp(wire, "order_ts")
    return wire.select(
        "o_orderkey", ts.alias("order_ts"), ts.cast("date").alias("order_day"), F.col("amount").cast("double").alias("amount")
    )


@query(
    "X2_rounding",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, {rnd('l_extendedprice / 8', 2)} AS two, {rnd('l_extendedprice / 7', 4)} AS four,
        {rnd('l_extendedprice / 70000', 6)} AS six FROM lineitem""",
)
def rounding(spark, sf):
    price = F.col("l_extendedprice")
    return fx.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", N.round_to(price / 8, 2).alias("two"),
        N.round_to(price / 7, 4).alias("four"), N.round_to(price / 70000, 6).alias("six"),
    )


@query(
    "X3_date_arithmetic",
    """SELECT o_orderkey, cast(o_orderdate AS date) - 35 AS first_day, cast(o_orderdate AS date) - 8 AS last_day,
       cast(o_orderdate AS date) + 1 AS next_day FROM orders""",
)
def date_arithmetic(spark, sf):
    day = F.to_date("o_orderdate")
    return fx.table(spark, sf, "orders").select(
        "o_orderkey", F.date_sub(day, 35).alias("first_day"), F.date_sub(day, 8).alias("last_day"), F.date_add(day, 1).alias("next_day")
    )


@query(
    "X4_null_rate",
    f"""SELECT lang, {rnd('avg(case when quality is null then 1 else 0 end)', 4)} AS quality_null_rate
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""",
)
def null_rate(spark, sf):
    joined = fx.table(spark, sf, "documents").select("doc_id", "lang").join(
        fx.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left"
    )
    return joined.groupBy("lang").agg(N.round_to(N.null_rate(F.col("quality")), 4).alias("quality_null_rate"))


@query(
    "X5_safe_ratio",
    f"SELECT l_orderkey, l_linenumber, l_partkey, {rnd('l_tax / nullif(l_discount, 0)', 4)} AS ratio FROM lineitem",
)
def safe_ratio(spark, sf):
    return fx.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        N.round_to(N.safe_ratio(F.col("l_tax"), F.col("l_discount")), 4).alias("ratio"),
    )


@query("X6_clamp", f"SELECT event_id, {rnd('greatest(0, least(1, value / 100 - 0.2))', 4)} AS confidence FROM events")
def clamp(spark, sf):
    return fx.table(spark, sf, "events").select(
        "event_id", N.round_to(N.clamp(F.col("value") / 100 - 0.2), 4).alias("confidence")
    )


@query("X7_payload_contains", "SELECT doc_id, contains(lower(text), lower(source)) AS mentions FROM documents")
def payload_contains(spark, sf):
    return fx.table(spark, sf, "documents").select(
        "doc_id", F.contains(F.lower("text"), F.lower("source")).alias("mentions")
    )


@query("X8_short_id", "SELECT o_orderkey, substr(md5('order-' || o_orderkey), 1, 16) AS short_id FROM orders")
def short_id(spark, sf):
    return fx.table(spark, sf, "orders").select(
        "o_orderkey", F.substring(F.md5(F.concat(F.lit("order-"), "o_orderkey")), 1, 16).alias("short_id")
    )


@query("X9_truncation", "SELECT doc_id, substr(text, 1, 200) AS title, substr(text, 1, 900) AS message FROM documents")
def truncation(spark, sf):
    return fx.table(spark, sf, "documents").select(
        "doc_id", F.substring("text", 1, 200).alias("title"), F.substring("text", 1, 900).alias("message")
    )


@query("X10_payload_access", "SELECT event_id, cast(regexp_extract(props, '[0-9]+') AS bigint) AS k FROM events")
def payload_access(spark, sf):
    return fx.table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query(
    "X11_integer_valued",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice = floor(l_extendedprice) AS whole FROM lineitem",
)
def integer_valued(spark, sf):
    return fx.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", N.is_integer_valued(F.col("l_extendedprice")).alias("whole")
    )
