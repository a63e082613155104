import random

import pytest

from pyspark.sql import functions as F

from driftlens.operators import lineage as L


def graph(spark, pairs):
    return spark.createDataFrame(pairs, "source string, target string")


def brute_reach(pairs, start, limit=None):
    seen, frontier, hop = {}, {start}, 0
    while frontier and (limit is None or hop < limit):
        hop += 1
        frontier = {t for s, t in pairs if s in frontier} - set(seen)
        seen.update({u: hop for u in frontier})
    return seen


def reach(spark, pairs, start, **kw):
    edges = graph(spark, pairs)
    return {r["urn"]: r["hop"] for r in L.reach(edges, L.roots_of(spark, edges, start), **kw).collect()}


def test_cycle_terminates_and_reports_the_start(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")]
    assert reach(spark, pairs, "a") == {"b": 1, "c": 2, "a": 3, "d": 3}
    assert reach(spark, pairs[:2], "a") == {"b": 1, "c": 2}


def test_random_graph_equals_brute_force(spark):
    rng = random.Random(3)
    pairs = [(str(rng.randrange(30)), str(rng.randrange(30))) for _ in range(45)]
    assert reach(spark, pairs, "1") == brute_reach(pairs, "1")
    assert reach(spark, pairs, "1", max_hops=2) == brute_reach(pairs, "1", 2)
    flipped = [(t, s) for s, t in pairs]
    assert reach(spark, pairs, "1", direction="upstream") == brute_reach(flipped, "1")


def test_traverse_keeps_edge_direction_and_bounds(spark):
    edges = graph(spark, [("raw", "stg"), ("raw", "stg"), ("fx", "fct"), ("stg", "fct"), ("fct", "kpi")])
    nodes, walked = L.traverse(edges, L.roots_of(spark, edges, "kpi"), "UPSTREAM", 2)
    assert {(r["urn"], r["hop"]) for r in nodes.collect()} == {("kpi", 0), ("fct", 1), ("stg", 2), ("fx", 2)}
    assert sorted((r["source"], r["target"]) for r in walked.collect()) == [("fct", "kpi"), ("fx", "fct"), ("stg", "fct")]


def test_many_roots_in_one_walk(spark):
    edges = graph(spark, [("a", "b"), ("b", "c"), ("x", "b")])
    got = {(r["root"], r["urn"]) for r in L.reach(edges, L.roots_of(spark, edges, "a", "x")).collect()}
    assert got == {("a", "b"), ("a", "c"), ("x", "b"), ("x", "c")}


def test_bad_direction(spark):
    edges = graph(spark, [("a", "b")])
    with pytest.raises(ValueError):
        L.reach(edges, L.roots_of(spark, edges, "a"), "SIDEWAYS")


def test_shortest_path(spark):
    edges = graph(spark, [("a", "b"), ("b", "d"), ("a", "c"), ("c", "d"), ("d", "e"), ("e", "a")])
    row = L.shortest_path(edges, "a", "e").first()
    assert row["hops"] == 3 and list(row["path"]) == ["a", "b", "d", "e"]
    assert L.shortest_path(edges, "a", "nowhere").count() == 0


def test_unknown_start_reaches_nothing(spark):
    assert reach(spark, [("a", "b")], "zzz") == {}


def test_anti_rows_reduces_its_keys(spark):
    from driftlens.operators import joins

    big = spark.range(100).selectExpr("id % 7 AS k", "id")
    small = spark.createDataFrame([(1,), (1,), (3,), (None,)], "k bigint")
    assert {r["k"] for r in joins.anti_rows(big, small, ["k"]).collect()} == {0, 2, 4, 5, 6}


def test_path_to_itself_has_no_hops(spark):
    edges = spark.createDataFrame([("a", "b")], "source string, target string")
    assert L.shortest_path(edges, "a", "a").first()["hops"] == 0


def test_column_names_may_hold_any_character(spark):
    rows = [("t#2", "x#1,y", "u", "c"), ("s", "c", "t#2", "x#1,y")]
    lineage = spark.createDataFrame(rows, "source string, source_col string, target string, target_col string")
    got = {(r["urn"], r["column"], r["hop"]) for r in L.column_reach(lineage, "u", "c", "UPSTREAM").collect()}
    assert got == {("t#2", "x#1,y", 1), ("s", "c", 2)}


def test_ties_do_not_depend_on_order(spark):
    from driftlens.operators.incidents import upsert_latest

    schema = "k string, ts int, v string"
    a, b = spark.createDataFrame([("k", 1, "z")], schema), spark.createDataFrame([("k", 1, "a")], schema)
    assert upsert_latest(a, b, ["k"], "ts").first()["v"] == "a" and upsert_latest(b, a, ["k"], "ts").first()["v"] == "z"
    seen = spark.createDataFrame([("k", 1, "z"), ("k", 1, "a")], schema)
    assert {L.merge_first_seen(seen.orderBy(F.col("v").asc() if up else F.col("v").desc()).coalesce(1), ["k"], "ts").first()["v"] for up in (0, 1)} == {"a"}


def test_long_chain_reads_few_runs(spark):
    """A chain of 60 hops: every hop opens few runs, and of these only the buckets it needs."""
    chain = spark.range(60).selectExpr("id AS source", "id + 1 AS target").unionByName(spark.sql("SELECT 50L AS source, 10L AS target"))
    walk = L.Walk(chain, L.roots_of(spark, chain, 0), "DOWNSTREAM")
    most_runs = most_buckets = 0
    while walk.rows:
        most_runs = max(most_runs, len(walk.runs))
        most_buckets = max(most_buckets, len(walk._buckets(walk.layers[-1])))
        walk.step()
    assert walk.hop in (61, 62) and most_runs <= 2 * L.Walk.FAN_IN and most_buckets <= 2
    assert {(r["urn"], r["hop"]) for r in walk.reached().collect()} == {(i, i) for i in range(1, 61)}


def test_every_root_is_walked_in_one_go(spark):
    edges = [(i, (i * 7 + k) % 40) for i in range(40) for k in (1, 5)]
    df = spark.createDataFrame(edges, "source long, target long")
    roots = [0, 3, 17]
    want = set()
    for root in roots:
        seen, frontier, hop = {}, {root}, 0
        while frontier:
            hop += 1
            frontier = {b for a, b in edges if a in frontier} - set(seen)
            seen.update({n: hop for n in frontier})
        want |= {(root, n, h) for n, h in seen.items()}
    assert {tuple(r) for r in L.reach(df, L.roots_of(spark, df, *roots)).collect()} == want


def test_shortest_path_on_a_dense_graph(spark):
    """Against all shortest paths of a layered graph with many equally short ones."""
    edges = [(f"{i}{a}", f"{i + 1}{b}") for i in range(5) for a in "abcd" for b in "abcd" if (a, b, i) not in {("a", "a", 1), ("a", "b", 1), ("b", "a", 3)}]
    edges += [("s", f"0{a}") for a in "abcd"] + [(f"5{a}", "t") for a in "bcd"] + [("5a", "0a")]
    df = spark.createDataFrame(edges, "source string, target string")
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    paths = [["s"]]
    while not any(p[-1] == "t" for p in paths):
        paths = [p + [n] for p in paths for n in out.get(p[-1], ())]
    row = L.shortest_path(df, "s", "t").first()
    assert row["path"] == min(p for p in paths if p[-1] == "t") and row["hops"] == len(row["path"]) - 1
    assert L.shortest_path(df, "t", "s").count() == 0 and L.shortest_path(df, "zzz", "t").count() == 0


def test_a_small_hop_is_one_file(spark):
    """Layers are not spread over a folder per bucket, which had to be listed by jobs of their own."""
    import pathlib

    chain = spark.range(6).selectExpr("id AS source", "id + 1 AS target")
    walk = L.Walk(chain, L.roots_of(spark, chain, 0), "DOWNSTREAM")
    while walk.rows:
        walk.step()
    files = [len(list(pathlib.Path(layer).rglob("*.parquet"))) for layer in walk.layers]
    folders = [p for layer in walk.layers for p in pathlib.Path(layer).iterdir() if p.is_dir()]
    assert max(files) == 1 and not folders
    assert all(len(walk._buckets(layer)) == 1 for layer in walk.layers[:-1])


def test_layers_are_merged_without_loss(spark):
    """A wide graph of 20 hops: merged runs still hold what was reached, whatever the buckets."""
    edges = [(h * 100 + i, (h + 1) * 100 + (3 * i + k) % 30) for h in range(20) for i in range(30) for k in (0, 1)] + [(1505, 3), (2007, 100)]
    df = spark.createDataFrame(edges, "source long, target long")
    got = {r["urn"]: r["hop"] for r in L.reach(df, L.roots_of(spark, df, 0)).collect()}
    assert got == brute_reach(edges, 0)
