"""Guarded SQL, profiles, files, catalog text, grading."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from driftlens.functions import naming, numeric as N
from driftlens.operators import catalog as K, grading as G, profile as P
from driftlens.plans import guarded
from driftlens.session import scratch_dir
from driftlens.sources import files as S


@pytest.mark.parametrize(
    "text",
    [
        "DROP TABLE t", "INSERT INTO t VALUES (1)", "SELECT 1; SELECT 2", "SELECT * FROM read_csv('/etc/hosts')",
        "SELECT java_method('java.lang.System', 'getenv')", "SELECT reflect('java.lang.System', 'getenv')",
        "SELECT try_reflect('java.lang.System', 'getenv')",
        "WITH x AS (SELECT 1 AS a) INSERT INTO t SELECT a FROM x", "",
        "SELECT TRANSFORM(x) USING 'cat' AS (y string) FROM (SELECT 1 AS x)",
        "FROM (SELECT 1 AS x) MAP x USING 'cat' AS y", "FROM (SELECT 1 AS x) REDUCE x USING 'cat' AS y",
        "SELECT (SELECT max(y) FROM (SELECT TRANSFORM(x) USING 'cat' AS (y string) FROM (SELECT 1 AS x)))",
        "WITH c AS (SELECT TRANSFORM(1) USING 'cat' AS (y string)) SELECT * FROM c",
        "SELECT 1 WHERE EXISTS (SELECT TRANSFORM(1) USING 'cat' AS (y string))",
        "SET spark.sql.ansi.enabled=false", "CACHE TABLE t", "ADD JAR 'x.jar'", "SHOW TABLES", "SELECT * FROM range(3)",
    ],
)
def test_guard_refuses(spark, text):
    with pytest.raises(guarded.Refused):
        guarded.run_sql(spark, text)


def test_guard_runs_and_reports_a_cut(spark, tmp_path):
    t = spark.range(200).toDF("x")
    whole = guarded.run_sql(spark, "select x from t_guard;", {"t_guard": t})
    assert whole.rows.count() == 200 and not whole.truncated
    some = guarded.run_sql(spark, "select x from t_guard", {"t_guard": t}, limit=50)
    assert some.rows.count() == 50 and some.truncated
    assert not guarded.run_sql(spark, "select x from t_guard", {"t_guard": t}, limit=200).truncated
    assert guarded.run_sql(spark, "SELECT 1 AS x").rows.collect()[0]["x"] == 1
    many = """WITH a AS (SELECT x % 7 AS k, count(*) AS n FROM t_guard GROUP BY 1 HAVING count(*) > 1)
              SELECT k, n, row_number() OVER (ORDER BY n) AS r FROM a WHERE n > (SELECT min(n) FROM a) UNION SELECT 0, 0, 0 ORDER BY 1 LIMIT 3"""
    assert guarded.run_sql(spark, many, {"t_guard": t}).rows.count() == 3
    path = str(tmp_path / "p")
    t.write.parquet(path)
    with pytest.raises(Exception):
        guarded.run_sql(spark, f"SELECT * FROM parquet.`{path}`").rows.collect()
    assert spark.conf.get("spark.sql.runSQLOnFiles") == "true"


def test_guard_gives_views_back(spark):
    spark.range(3).createOrReplaceTempView("t_mine")
    assert guarded.run_sql(spark, "SELECT * FROM t_mine", {"t_mine": spark.range(5)}).rows.count() == 5
    assert spark.table("t_mine").count() == 3
    guarded.run_sql(spark, "SELECT * FROM t_theirs", {"t_theirs": spark.range(5)})
    assert not spark.catalog.tableExists("t_theirs")


def test_profile_uses_calendar_days_and_all_segment(spark):
    rows = [(dt.datetime(2026, 1, 1), 1.0, "a"), (dt.datetime(2026, 1, 10), 2.0, "a"), (dt.datetime(2026, 1, 12), None, "b")]
    df = spark.createDataFrame(rows, "order_ts timestamp_ntz, amount double, p string")
    out = {(str(r["day"]), r["segment"]): r for r in P.profile_column(df, "amount", None, 3).collect()}
    assert set(out) == {("2026-01-10", "all"), ("2026-01-12", "all")}
    assert out[("2026-01-12", "all")]["null_rate"] == 1.0 and out[("2026-01-12", "all")]["median"] is None
    with pytest.raises(ValueError):
        P.profile_column(df, "nope")
    assert P.profile_column(df.limit(0), "amount").count() == 0


def test_profile_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).select(
        F.timestamp_seconds(F.col("id") * 86400).cast("timestamp_ntz").alias("order_ts"), F.col("id").cast("double").alias("amount"),
        F.lit("wide").alias("other"),
    ).write.parquet(path)
    rows, n = P.recent(spark.read.parquet(path), "order_ts", 5)
    plan = rows.select("amount")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(order_ts" in plan and "other" not in plan.split("ReadSchema")[1]
    assert n == 100 and rows.count() == 5


def test_csv_is_strict(spark, tmp_path):
    path = str(tmp_path / "c")
    spark.createDataFrame([("1", "x")], "amount string, b string").write.option("header", True).csv(path)
    assert S.read_csv(spark, path, "amount double, b string").first()["amount"] == 1.0
    bad = str(tmp_path / "d")
    spark.createDataFrame([("oops", "x")], "amount string, b string").write.option("header", True).csv(bad)
    with pytest.raises(Exception):
        S.read_csv(spark, bad, "amount double, b string").collect()
    with pytest.raises(Exception):
        S.read_csv(spark, str(tmp_path / "none"), "amount double, b string")


def test_malformed_transcript_lines_are_skipped(spark):
    path = scratch_dir(spark, "lines")
    lines = ['{"incident_id": "a", "turn": 1, "stop_reason": "tool_use"}', '{"incident_id": "a", "turn"', '{"incident_id": "a", "turn": 1, "tool_result_for": "x"}']
    spark.createDataFrame([(v,) for v in lines], "value string").write.text(path)
    got = G.transcript_stats(S.read_transcripts(spark, path)).first()
    assert (got["turns"], got["tool_calls"]) == (1, 1)


def test_notes_round_trip(spark):
    text = "wörter " * 20_000 + "end"
    df = spark.createDataFrame([("u", text, ["kpi"]), ("v", None, None)], "urn string, description string, tags array<string>")
    none = spark.createDataFrame([], "urn string, incident_id string, ts timestamp, text string")
    at = dt.datetime(2026, 1, 1)
    batch = spark.createDataFrame(
        [("u", "inc_1", at, "Field: amount"), ("u", "inc_1", at + dt.timedelta(1), "later"), ("u", "inc_2", at + dt.timedelta(2), "x"), ("v", "inc_1", at, "y")],
        none.schema,
    )
    once = K.append_notes(none, batch)
    twice = K.append_notes(once, batch)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) and once.count() == 3
    shown = {r["urn"]: r["description"] for r in K.render_notes(df, twice).collect()}
    assert shown["u"] == text + "\n\n[inc_1] Field: amount\n\n[inc_2] x"
    assert {r["urn"] for r in K.contaminated(df, twice).collect()} == {"u", "v"}
    tagged = df.withColumn("tags", K.with_tag(F.col("tags")))
    clean = {r["urn"]: r for r in K.scrub(tagged, twice).collect()}
    assert clean["u"]["description"] == text and clean["u"]["tags"] == ["kpi"]
    assert clean["u"]["note_cleared"] and clean["u"]["tag_removed"]
    left = K.scrub_notes(twice, df.filter("urn = 'u'"))
    assert [r["urn"] for r in left.collect()] == ["v"]
    assert not K.scrub(df, none).first()["note_cleared"]


def test_search_ranks_whole_words(spark):
    assets = spark.createDataFrame(
        [("u1", "exec_revenue", "Executive revenue KPI"), ("u2", "orders", "revenues only"), ("u3", "fct", "revenue fact")],
        "urn string, name string, description string",
    )
    got = [(r["urn"], r["score"]) for r in K.search(assets, "Executive REVENUE", 20).collect()]
    assert got == [("u1", 2), ("u3", 1)]
    other = spark.createDataFrame([("u1", "größe", "gr e"), ("u2", "gr", "e"), ("u3", "слово", "")], assets.schema)
    assert [r["urn"] for r in K.search(other, "Größe", 5).collect()] == ["u1"]
    assert [r["urn"] for r in K.search(other, "Слово", 5).collect()] == ["u3"]


def test_layers_and_urns(spark):
    names = {"raw.raw_orders": "source", "stg_x": "staging", "m.fct_a": "marts", "dim_a": "marts", "exec_a": "metric", "bi.sales_dashboard": "metric", "other": "marts"}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r["n"]: r["l"] for r in df.select("n", naming.layer_of(F.col("n")).alias("l")).collect()} == names
    urn = "urn:li:dataset:(urn:li:dataPlatform:duckdb,marts.fct_revenue,PROD)"
    one = spark.createDataFrame([(urn,), ("plain",)], "u string").select(naming.dataset_name(F.col("u")), naming.dataset_platform(F.col("u"))).collect()
    assert [tuple(r) for r in one] == [("marts.fct_revenue", "duckdb"), ("plain", "unknown")]


def test_schema_introspection_with_docs(spark):
    fields = K.introspect({"t": spark.createDataFrame([], "a int, b string")})
    docs = spark.createDataFrame([("t", "a", "the a")], "urn string, field string, description string")
    got = {r["field"]: (r["type"], r["description"]) for r in K.document_fields(fields, docs).collect()}
    assert got == {"a": ("int", "the a"), "b": ("string", "")}


def test_numeric_helpers(spark):
    row = spark.range(1).select(
        N.round_to(F.lit(1.005), 2).alias("tie"), N.safe_ratio(F.lit(1.0), F.lit(0.0)).alias("zero"),
        N.clamp(F.lit(1.4)).alias("hi"), N.clamp(F.lit(-1.0)).alias("lo"), N.percent_delta(F.lit(3.0), F.lit(2.0)).alias("pct"),
    ).first()
    assert (row["tie"], row["zero"], row["hi"], row["lo"], row["pct"]) == (1.01, None, 1.0, 0.0, 50.0)


def test_run_status(spark):
    df = spark.createDataFrame([({"a": True}, False), ({"a": True, "b": False}, False), ({}, False), (None, False), ({"a": True}, True)], "c map<string,boolean>, s boolean")
    assert [r[0] for r in df.select(G.run_status(F.col("c"), F.col("s"))).collect()] == ["passed", "failed", "error", "error", "skipped"]


def test_quarantine_keeps_every_bad_line(spark):
    path = scratch_dir(spark, "lines")
    lines = [
        '{"incident_id": "a", "turn": 1, "stop_reason": "tool_use", "tools": [{"name": "t", "input_keys": ["q"]}], "usage": {"in": 7, "out": 2}}',
        '{"incident_id": "a", "turn"', "", "no JSON at all", '{"incident_id": "b\\"c", "turn": "x"}', '[1, 2]',
    ]
    spark.createDataFrame([(v,) for v in lines], "value string").coalesce(1).write.text(path)
    good, rejected = S.quarantine(spark, path, scratch_dir(spark, "rejected"))
    row = good.first()
    assert good.count() == 1 and (row["usage"]["in"], row["tools"][0]["name"]) == (7, "t")
    got = {r["line"]: (r["reason"], r["incident_id"]) for r in rejected.collect()}
    assert got[lines[1]] == ("not JSON", "a") and got["no JSON at all"] == ("not JSON", None)
    assert got[lines[4]] == ("not a transcript line", 'b\\"c') and all(r["file"] for r in rejected.collect())
    assert "" not in got and S.read_transcripts(spark, path).count() == 1
