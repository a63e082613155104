"""Lineage traversal and catalog queries.

The graph has an edge from floor(k/2) and floor(k/3) to every order k, so its depth
grows with the logarithm of the table and diamonds are everywhere. Assets are parts,
described by documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from driftlens.functions import naming
from driftlens.operators import catalog as K, lineage as L
from driftlens.operators.baseline import health_status
from driftlens.session import scratch_dir
from driftlens.sources import publish
from driftlens.suite import inputs as fx
from driftlens.suite.oracle import mart_ctes, sql
from driftlens.suite.registry import query
from driftlens.suite.revenue import incident_build

DEEP = 1000  # an order far from the root of the graph, present at every scale

_PLATFORM = "case {id} % 3 when 0 then 'duckdb' when 1 then 'spark' else 'files' end"
_NAME = (
    "case {id} % 7 when 0 then 'raw.raw_' when 1 then 'staging.stg_' when 2 then 'marts.fct_'"
    " when 3 then 'marts.dim_' when 4 then 'marts.exec_' when 5 then 'bi.sales_dashboard_'"
    " else 'misc.item_' end"
)


def name_sql(key: str) -> str:
    return f"concat({_NAME.format(id=key)}, cast({key} as string))"


def urn_sql(key: str) -> str:
    """URN of an asset id; the same text is valid in Spark and in DuckDB."""
    return (
        f"concat('urn:li:dataset:(urn:li:dataPlatform:', {_PLATFORM.format(id=key)}, ',',"
        f" {name_sql(key)}, ',PROD)')"
    )


EDGES = """
edges AS (SELECT DISTINCT source, target FROM (
  SELECT o_orderkey // 2 AS source, o_orderkey AS target FROM orders WHERE o_orderkey > 0
  UNION ALL SELECT o_orderkey // 3, o_orderkey FROM orders WHERE o_orderkey > 0)),
column_lineage AS (
  SELECT source, target, 'amount' AS source_col, 'amount' AS target_col FROM edges
  UNION ALL SELECT source, target, 'currency', 'currency' FROM edges WHERE target % 2 = 0
  UNION ALL SELECT source, target, 'currency', 'amount' FROM edges WHERE target % 3 = 0)"""


def edges(spark, sf) -> DataFrame:
    """The edge table of the catalog."""

    def derive() -> DataFrame:
        # Both edges of an order end in it, so distinct keys give distinct edges: keys move, not pairs.
        keys = fx.table(spark, sf, "orders").filter("o_orderkey > 0").select(F.col("o_orderkey").alias("target")).distinct()
        return keys.select(F.expr("explode(array_distinct(array(target div 2, target div 3)))").alias("source"), "target")

    return fx.stored(spark, sf, "lineage-edges", derive)


def edges_with_maps(spark, sf) -> DataFrame:
    """Edges as a catalog delivers them: a map of downstream column to upstream columns."""
    return edges(spark, sf).withColumn(
        "column_map",
        F.expr(
            """map_concat(
                 map('amount', if(target % 3 = 0, array('amount', 'currency'), array('amount'))),
                 if(target % 2 = 0, map('currency', array('currency')), map()))"""
        ),
    )


def column_lineage(spark, sf) -> DataFrame:
    return K.explode_column_maps(edges_with_maps(spark, sf))


ASSETS = f"""
assets AS (
  SELECT p_partkey AS id, {urn_sql('p_partkey')} AS urn, {name_sql('p_partkey')} AS name,
    concat(p_name, ' ', d.text) AS description,
    case when p_size % 3 = 0 then concat('Edited: ', p_name) else '' end AS editable_description,
    p_brand AS tag, p_size
  FROM part LEFT JOIN documents d ON d.doc_id = p_partkey),
asset_fields AS (
  SELECT urn, 'amount' AS field, 'double' AS type,
    case when p_size % 2 = 1 then 'Order amount in major currency units' else '' end AS description,
    case when p_size % 4 = 0 then 'Edited amount' else '' end AS editable_description FROM assets
  UNION ALL
  SELECT urn, 'currency', 'string', 'ISO code', case when p_size % 4 = 1 then 'Edited code' else '' end FROM assets),
owners AS (
  SELECT {urn_sql('p_partkey')} AS urn, n_name AS owner FROM part JOIN nation ON n_nationkey = p_partkey % 25
  UNION ALL
  SELECT {urn_sql('p_partkey')}, s_name FROM part JOIN supplier ON s_suppkey = p_partkey % 10),
asset_incidents AS (
  SELECT {urn_sql('o_custkey')} AS urn, case when o_orderstatus = 'P' then 'ACTIVE' else 'RESOLVED' end AS state FROM orders),
asset_checks AS (
  SELECT {urn_sql('l_partkey')} AS urn, NOT (l_quantity = 50 AND l_discount >= 0.09) AS passed FROM lineitem),
entries AS (
  SELECT urn, concat('INCIDENTS FAIL ', count(*), ' active incidents') AS e FROM asset_incidents
    WHERE state = 'ACTIVE' GROUP BY 1
  UNION ALL
  SELECT urn, concat('ASSERTIONS FAIL ', count(*), ' failing checks') FROM asset_checks WHERE NOT passed GROUP BY 1),
health AS (SELECT urn, string_agg(e, '; ' ORDER BY e) AS health FROM entries GROUP BY 1)"""
ASSETS = ASSETS.replace(" as string)", " as varchar)")


_DESCRIPTION = "concat_ws(' ', p_name, coalesce(text, ''))"


def assets(spark, sf) -> DataFrame:
    docs = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("p_partkey"), "text")
    return fx.table(spark, sf, "part").join(docs, "p_partkey", "left").select(
        F.col("p_partkey").alias("id"),
        F.expr(urn_sql("p_partkey")).alias("urn"),
        F.expr(name_sql("p_partkey")).alias("name"),
        F.expr(_DESCRIPTION).alias("description"),
        F.expr("case when p_size % 3 = 0 then concat('Edited: ', p_name) else '' end").alias("editable_description"),
        F.col("p_brand").alias("tag"),
        "p_size",
    )


def asset_fields(spark, sf) -> DataFrame:
    return fx.table(spark, sf, "part").select(
        F.expr(urn_sql("p_partkey")).alias("urn"),
        F.expr(
            """inline(array(
                named_struct('field', 'amount', 'type', 'double',
                  'description', if(p_size % 2 = 1, 'Order amount in major currency units', ''),
                  'editable_description', if(p_size % 4 = 0, 'Edited amount', '')),
                named_struct('field', 'currency', 'type', 'string', 'description', 'ISO code',
                  'editable_description', if(p_size % 4 = 1, 'Edited code', ''))))"""
        ),
    )


def owners(spark, sf) -> DataFrame:
    part = fx.table(spark, sf, "part").select("p_partkey", F.expr(urn_sql("p_partkey")).alias("urn"))
    nation = fx.table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("owner"))
    supplier = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("owner"))
    by_nation = part.withColumn("k", F.col("p_partkey") % 25).join(nation, "k")
    by_supplier = part.withColumn("k", F.col("p_partkey") % 10).join(supplier, "k")
    return by_nation.select("urn", "owner").unionByName(by_supplier.select("urn", "owner"))


def asset_incidents(spark, sf) -> DataFrame:
    return fx.table(spark, sf, "orders").select(
        F.expr(urn_sql("o_custkey")).alias("urn"),
        F.expr("if(o_orderstatus = 'P', 'ACTIVE', 'RESOLVED')").alias("state"),
    )


def asset_checks(spark, sf) -> DataFrame:
    return fx.table(spark, sf, "lineitem").select(
        F.expr(urn_sql("l_partkey")).alias("urn"),
        F.expr("NOT (l_quantity = 50 AND l_discount >= 0.09D)").alias("passed"),
    )


def health(spark, sf) -> DataFrame:
    return K.estate_health(assets(spark, sf), asset_incidents(spark, sf), asset_checks(spark, sf))


def health_text():
    return F.array_join(F.transform("health", lambda h: F.concat_ws(" ", h["type"], h["status"], h["message"])), "; ")


# --- names --------------------------------------------------------------------------

@query(
    "P10_layer_inference",
    sql(ASSETS, """SELECT name, case when last like 'raw\\_%' escape '\\' then 'source'
        when last like 'stg\\_%' escape '\\' then 'staging' when last like 'fct\\_%' escape '\\' then 'marts'
        when last like 'dim\\_%' escape '\\' then 'marts' when last like 'exec\\_%' escape '\\' then 'metric'
        when last like '%metric%' or last like '%dashboard%' then 'metric' else 'marts' end AS layer
        FROM (SELECT name, split_part(name, '.', 2) AS last FROM assets)"""),
)
def layer_inference(spark, sf):
    return assets(spark, sf).select("name", naming.layer_of(F.col("name")).alias("layer"))


_MIXED = "case when {k} % 11 = 0 then concat('urn:other:', cast({k} as {s})) else {u} end"
_FIELD_URN = "concat('urn:li:schemaField:(', {u}, ',amount)')"


@query(
    "P11_urn_parsing",
    "SELECT urn, regexp_extract(f, '^urn:li:schemaField:\\((.+),([^,]+)\\)$', 2) AS field,"
    " case when urn like 'urn:other:%' then urn else split_part(urn, ',', 2) end AS name,"
    " case when urn like 'urn:other:%' then 'unknown' else split_part(split_part(urn, ',', 1), 'dataPlatform:', 2) end AS platform"
    " FROM (SELECT urn, " + _FIELD_URN.format(u="urn") + " AS f FROM (SELECT "
    + _MIXED.format(k="p_partkey", s="varchar", u=urn_sql("p_partkey").replace(" as string)", " as varchar)"))
    + " AS urn FROM part))",
)
def urn_parsing(spark, sf):
    urns = fx.table(spark, sf, "part").select(
        F.expr(_MIXED.format(k="p_partkey", s="string", u=urn_sql("p_partkey"))).alias("urn")
    )
    _, field = naming.field_parts(F.expr(_FIELD_URN.format(u="urn")))
    return urns.select(
        "urn", field.alias("field"),
        naming.dataset_name(F.col("urn")).alias("name"),
        naming.dataset_platform(F.col("urn")).alias("platform"),
    )


# --- traversal ------------------------------------------------------------------------

def _walk(direction: str, root: int, hops: int | None) -> str:
    near, far = ("target", "source") if direction == "up" else ("source", "target")
    stop = f" AND w.hop < {hops}" if hops else ""
    return EDGES + f""",
walk(urn, hop) AS (
  SELECT {root}::bigint, 0 UNION
  SELECT e.{far}, w.hop + 1 FROM walk w JOIN edges e ON e.{near} = w.urn WHERE true{stop}),
nodes AS (SELECT urn, min(hop) AS hop FROM walk GROUP BY 1)"""


_CATALOGS: dict[tuple[str, str], str] = {}


def loaded_catalog(spark, sf) -> dict[str, DataFrame]:
    """The five tables of the catalog, published as one release per application."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _CATALOGS:
        root = scratch_dir(spark, "catalog")
        publish.publish(spark, root, K.load_steps(catalog_source(spark, sf), edges_with_maps(spark, sf)))
        _CATALOGS[key] = root
    return publish.read(spark, _CATALOGS[key])


def catalog_source(spark, sf) -> DataFrame:
    """One row per asset as its system describes it, with lists of owners and tags and a map of properties.

    All parts are dealt by urn, which is also how the catalog drops repeats, so a text moves
    once; and they have one row per urn, so a table that needs no text or owner leaves them out.
    """
    people = owners(spark, sf).groupBy("urn").agg(F.collect_list("owner").alias("owners"))
    docs = fx.table(spark, sf, "documents").select(F.expr(urn_sql("doc_id")).alias("urn"), "text")
    docs = docs.repartition("urn").dropDuplicates(["urn"])
    parts = fx.table(spark, sf, "part").select(
        F.expr(urn_sql("p_partkey")).alias("urn"), F.expr(name_sql("p_partkey")).alias("name"), "p_name", "p_brand", "p_size"
    )
    return parts.join(docs, "urn", "left").join(people, "urn", "left").select(
        "urn", "name", F.expr(_DESCRIPTION).alias("description"), F.array("p_brand", F.concat(F.lit("size-"), "p_size")).alias("tags"),
        F.create_map(F.lit("pipeline"), naming.layer_of(F.col("name")), F.lit("size"), F.col("p_size").cast("string")).alias("properties"),
        "owners",
    )


def _load(name: str, columns: str, text: str) -> None:
    @query(f"L1_load_{name}", sql(ASSETS + "," + EDGES, text))
    def run(spark, sf):
        return loaded_catalog(spark, sf)[name].select(*columns.split())


_load("assets", "urn name description", "SELECT urn, name, description FROM assets")
_load("owners", "urn owner", "SELECT DISTINCT urn, owner FROM owners")
_load("tags", "urn tag", "SELECT urn, tag FROM assets UNION SELECT urn, 'size-' || p_size FROM assets")
_load(
    "properties", "urn key value",
    """SELECT urn, 'size' AS key, cast(p_size AS varchar) AS value FROM assets UNION ALL
       SELECT urn, 'pipeline', case when last like 'raw\\_%' escape '\\' then 'source'
         when last like 'stg\\_%' escape '\\' then 'staging' when last like 'fct\\_%' escape '\\' then 'marts'
         when last like 'dim\\_%' escape '\\' then 'marts' when last like 'exec\\_%' escape '\\' then 'metric'
         when last like '%metric%' or last like '%dashboard%' then 'metric' else 'marts' end
       FROM (SELECT urn, split_part(name, '.', 2) AS last FROM assets)""",
)
_load("edges", "source target source_col target_col", "SELECT * FROM column_lineage")


@query("L1_load_column_maps", sql(EDGES, "SELECT * FROM column_lineage"))
def load_column_maps(spark, sf):
    return column_lineage(spark, sf)


@query("J12_frontier_hop", sql(EDGES, "SELECT DISTINCT source AS root, target AS urn FROM edges WHERE source IN (1, 2, 3)"))
def frontier_hop(spark, sf):
    graph = edges(spark, sf)
    frontier = L.roots_of(spark, graph, 1, 2, 3).select(F.col("urn").alias("root"), "urn")
    return L.one_hop(graph, frontier, "DOWNSTREAM")


@query("L2_upstream", sql(_walk("up", DEEP, 3), "SELECT * FROM nodes", True))
def upstream(spark, sf):
    graph = edges(spark, sf)
    return L.traverse(graph, L.roots_of(spark, graph, DEEP), "UPSTREAM", 3)[0].select("urn", "hop")


@query(
    "L2_upstream_edges",
    sql(_walk("up", DEEP, 3), "SELECT source, target FROM edges JOIN nodes ON target = urn WHERE hop < 3", True),
)
def upstream_edges(spark, sf):
    graph = edges(spark, sf)
    return L.traverse(graph, L.roots_of(spark, graph, DEEP), "UPSTREAM", 3)[1].select("source", "target")


@query("L3_downstream", sql(_walk("down", 1, 3), "SELECT * FROM nodes", True))
def downstream(spark, sf):
    graph = edges(spark, sf)
    return L.traverse(graph, L.roots_of(spark, graph, 1), "DOWNSTREAM", 3)[0].select("urn", "hop")


_EDGE_COLUMNS = """SELECT e.source, e.target, coalesce(string_agg(c.source_col || '>' || c.target_col, ','
    ORDER BY c.source_col || '>' || c.target_col), '') AS columns
    FROM edges e LEFT JOIN column_lineage c ON e.source = c.source AND e.target = c.target"""


def _columns_text():
    return F.array_join(F.transform("columns", lambda c: F.concat(c["upstream"], F.lit(">"), c["downstream"])), ",")


@query("L4_edge_columns", sql(EDGES, _EDGE_COLUMNS + " GROUP BY 1, 2"))
def edge_columns(spark, sf):
    mapped = L.attach_columns(edges(spark, sf), column_lineage(spark, sf))
    return mapped.select("source", "target", _columns_text().alias("columns"))


@query(
    "L5_column_upstream",
    sql(EDGES + f""", walk(urn, col, hop) AS (
          SELECT {DEEP + 100}::bigint, 'amount', 0 UNION
          SELECT c.source, c.source_col, w.hop + 1 FROM walk w JOIN column_lineage c
            ON c.target = w.urn AND c.target_col = w.col)""",
        """SELECT cast(urn AS varchar) AS urn, col AS "column", cast(min(hop) AS integer) AS hop
           FROM walk WHERE hop > 0 GROUP BY 1, 2""", True),
)
def column_upstream(spark, sf):
    return L.column_reach(column_lineage(spark, sf), DEEP + 100, "amount", "UPSTREAM")


@query("L6_blast_radius", sql(_walk("down", 0, None), "SELECT urn, hop FROM nodes WHERE hop > 0", True))
def blast_radius(spark, sf):
    graph = edges(spark, sf)
    return L.blast_radius(graph, L.roots_of(spark, graph, 0)).select("urn", "hop")


@query(
    "L7_shortest_path",
    sql(EDGES + f""", walk(urn, path) AS (
          SELECT {DEEP}::bigint, [{DEEP}::bigint] UNION ALL
          SELECT e.source, list_prepend(e.source, w.path) FROM walk w JOIN edges e ON e.target = w.urn)""",
        """SELECT cast(len(path) - 1 AS integer) AS hops, array_to_string(path, '>') AS path FROM walk
           WHERE urn = 0 ORDER BY len(path), walk.path LIMIT 1""", True),
)
def shortest_path(spark, sf):
    found = L.shortest_path(edges(spark, sf), 0, DEEP)
    return found.select("hops", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


_TERMS = "list_distinct(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'))"
SEARCH = "small red anvil major de and für que à"
_SCORE = (
    f"len(list_intersect({_TERMS.format(x='concat_ws(chr(32), name, description)')}, "
    + _TERMS.format(x=f"'{SEARCH}'") + "))"
)


@query(
    "L8_catalog_search",
    sql(ASSETS, f"""SELECT urn, name, cast(score AS integer) AS score FROM (SELECT urn, name, {_SCORE} AS score FROM assets)
        WHERE score > 0 ORDER BY score DESC, urn LIMIT 20"""),
)
def catalog_search(spark, sf):
    return K.search(assets(spark, sf), SEARCH, limit=20)


@query(
    "L9_asset_context",
    sql(ASSETS + """, f AS (SELECT urn, string_agg(field || ':' || type || ':' || coalesce(nullif(editable_description, ''),
           description), ';' ORDER BY field) AS fields FROM asset_fields GROUP BY 1),
         o AS (SELECT urn, string_agg(DISTINCT owner, ';' ORDER BY owner) AS owners FROM owners GROUP BY 1)""",
        """SELECT a.urn, a.name, coalesce(nullif(a.editable_description, ''), a.description) AS description,
           f.fields, o.owners FROM assets a LEFT JOIN f ON a.urn = f.urn LEFT JOIN o ON a.urn = o.urn"""),
)
def asset_context(spark, sf):
    base = assets(spark, sf).drop("id", "tag", "p_size")
    out = K.asset_context(base, asset_fields(spark, sf), owners(spark, sf))
    text = F.transform("fields", lambda f: F.concat_ws(":", f["field"], f["type"], f["description"]))
    return out.select(
        "urn", "name", "description",
        F.array_join(text, ";").alias("fields"), F.array_join("owners", ";").alias("owners"),
    )


@query(
    "S9_schema_docs",
    sql(ASSETS, "SELECT f.urn, f.field, f.type, coalesce(a.tag, '') AS description FROM asset_fields f"
        " LEFT JOIN assets a ON a.urn = f.urn AND f.field = 'amount'"),
)
def schema_docs(spark, sf):
    """Fields joined with their documentation; here the brand documents the amount."""
    docs = assets(spark, sf).select("urn", F.lit("amount").alias("field"), F.col("tag").alias("description"))
    return K.document_fields(asset_fields(spark, sf).select("urn", "field", "type"), docs)


@query(
    "L10_frontier_enrichment",
    sql(_walk("down", 1, 3) + "," + ASSETS + f""", wanted AS (SELECT {urn_sql('urn').replace(' as string)', ' as varchar)')} AS urn FROM nodes),
        o AS (SELECT urn, string_agg(DISTINCT owner, ';' ORDER BY owner) AS owners FROM owners GROUP BY 1)""",
        """SELECT a.urn, a.name, o.owners, h.health FROM assets a SEMI JOIN wanted w ON a.urn = w.urn
           LEFT JOIN o ON a.urn = o.urn LEFT JOIN health h ON a.urn = h.urn""", True),
)
def frontier_enrichment(spark, sf):
    graph = edges(spark, sf)
    nodes, _ = L.traverse(graph, L.roots_of(spark, graph, 1), "DOWNSTREAM", 3)
    wanted = nodes.select(F.expr(urn_sql("urn")).alias("urn"))
    out = K.enrich(wanted, assets(spark, sf), owners(spark, sf), health(spark, sf))
    return out.select("urn", "name", F.array_join("owners", ";").alias("owners"), health_text().alias("health"))


@query("L11_estate_health", sql(ASSETS, "SELECT a.urn, a.name, h.health FROM assets a JOIN health h ON a.urn = h.urn"))
def estate_health(spark, sf):
    return health(spark, sf).select("urn", "name", health_text().alias("health"))


CAUSE = 5
_STATES = "case o_orderstatus when 'O' then '{o}' when 'F' then 'investigating' else 'repaired' end"


def graph_nodes(spark, sf, o: str) -> DataFrame:
    return fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("urn"), F.expr(_STATES.format(o=o)).alias("status")
    )


_AFTER_CONFIRM = f"""SELECT o_orderkey AS urn, case when o_orderkey = {CAUSE} then 'root_cause'
    when n.urn IS NOT NULL AND o_orderstatus IN ('O', 'F') then 'affected'
    else {_STATES.format(o='healthy')} end AS status
    FROM orders LEFT JOIN (SELECT urn FROM nodes WHERE hop > 0) n ON o_orderkey = n.urn"""


@query("L12_status_confirmed", sql(_walk("down", CAUSE, None), _AFTER_CONFIRM, True))
def status_confirmed(spark, sf):
    return L.propagate_status(graph_nodes(spark, sf, "healthy"), edges(spark, sf), CAUSE)


@query(
    "L12_status_verified",
    sql(_walk("down", CAUSE, None), f"""SELECT o_orderkey AS urn, case when o_orderkey = {CAUSE} then 'repaired'
        when n.urn IS NOT NULL AND o_orderstatus IN ('O', 'F') then 'healthy'
        else {_STATES.format(o='affected')} end AS status
        FROM orders LEFT JOIN (SELECT urn FROM nodes WHERE hop > 0) n ON o_orderkey = n.urn""", True),
)
def status_verified(spark, sf):
    return L.propagate_status(graph_nodes(spark, sf, "affected"), edges(spark, sf), CAUSE, verified=True)


@query(
    "A14_affected_count",
    sql(_walk("down", CAUSE, None) + f", s AS ({_AFTER_CONFIRM})",
        "SELECT count(*) AS affected FROM s WHERE status IN ('suspicious', 'affected', 'root_cause')", True),
)
def affected_count(spark, sf):
    return L.affected_count(status_confirmed(spark, sf))


@query(
    "L13_kpi_graph",
    sql(_walk("up", DEEP, 4) + "," + mart_ctes("incident"), f"""SELECT n.urn, {name_sql('n.urn').replace(' as string)', ' as varchar)')} AS name,
        case n.urn % 7 when 0 then 'source' when 1 then 'staging' when 4 then 'metric' when 5 then 'metric' else 'marts' end AS layer,
        case when n.urn = {DEEP} AND (k.anomaly_ratio > 1.5 OR k.anomaly_ratio < 0.6) then 'affected' else 'healthy' end AS status
        FROM nodes n, kpi k""", True),
)
def kpi_graph(spark, sf):
    """Upstream graph of the KPI asset; the KPI node is affected while the metric is anomalous."""
    graph = edges(spark, sf)
    nodes, _ = L.traverse(graph, L.roots_of(spark, graph, DEEP), "UPSTREAM", 4)
    metric = incident_build(spark, sf).exec_revenue_metric.select(
        health_status(F.col("anomaly_ratio")).alias("_metric")
    )
    name = F.expr(name_sql("urn"))
    hit = (F.col("urn") == DEEP) & (F.col("_metric") == "anomalous")
    return nodes.join(F.broadcast(metric), how="left", on=F.lit(True)).select(  # one row
        "urn", name.alias("name"), naming.layer_of(name).alias("layer"),
        F.when(hit, "affected").otherwise("healthy").alias("status"),
    )


_BEFORE = "SELECT urn, field, type FROM asset_fields"
_SNAP = """
before_fields AS (SELECT urn, field, type FROM asset_fields),
after_fields AS (
  SELECT a.urn, f.field, case when a.p_size % 3 = 0 AND f.field = 'amount' then 'decimal' else f.type end AS type
  FROM asset_fields f JOIN assets a ON a.urn = f.urn WHERE NOT (f.field = 'currency' AND a.p_size % 5 = 0)
  UNION ALL SELECT urn, 'region', 'string' FROM assets WHERE p_size % 4 = 0)"""


@query(
    "L14_schema_changes",
    sql(ASSETS + "," + _SNAP, """SELECT coalesce(b.urn, a.urn) AS urn, coalesce(b.field, a.field) AS field, b.type AS old_type,
        a.type AS new_type, case when b.type IS NULL then 'added' when a.type IS NULL then 'removed' else 'retyped' end AS change
        FROM before_fields b FULL JOIN after_fields a ON a.urn = b.urn AND a.field = b.field
        WHERE b.type IS DISTINCT FROM a.type"""),
)
def schema_changes(spark, sf):
    before = asset_fields(spark, sf).select("urn", "field", "type")
    sizes = fx.table(spark, sf, "part").select(F.expr(urn_sql("p_partkey")).alias("urn"), "p_size")
    kept = K.dealt(before, "urn").join(K.dealt(sizes, "urn"), "urn").filter("NOT (field = 'currency' AND p_size % 5 = 0)").select(
        "urn", "field", F.expr("if(p_size % 3 = 0 AND field = 'amount', 'decimal', type)").alias("type")
    )
    added = sizes.filter("p_size % 4 = 0").select("urn", F.lit("region").alias("field"), F.lit("string").alias("type"))
    return K.schema_changes(before, kept.unionByName(added))


@query(
    "A15_catalog_summary",
    sql(_walk("up", DEEP, 4) + "," + ASSETS + f""", hit AS (SELECT urn FROM (SELECT urn, {_SCORE} AS score FROM assets)
          WHERE score > 0 ORDER BY score DESC, urn LIMIT 20),
        walked AS (SELECT source, target FROM edges JOIN nodes ON target = urn WHERE hop < 4)""",
        """SELECT (SELECT count(*) FROM hit) AS search_hits, (SELECT count(*) FROM nodes) AS lineage_nodes,
           (SELECT count(*) FROM walked) AS lineage_edges,
           (SELECT count(*) FROM walked w SEMI JOIN column_lineage c ON w.source = c.source AND w.target = c.target)
             AS column_mapped_edges,
           (SELECT count(*) > 0 FROM asset_fields WHERE lower(description) LIKE '%major currency units%') AS contract_present""",
        True),
)
def catalog_summary(spark, sf):
    graph = edges(spark, sf)
    nodes, walked = L.traverse(graph, L.roots_of(spark, graph, DEEP), "UPSTREAM", 4)
    mapped = L.attach_columns(walked, column_lineage(spark, sf))
    hits = K.search(assets(spark, sf), SEARCH, limit=20)
    return K.summary(nodes, mapped, hits, asset_fields(spark, sf))


@query(
    "U5_merge_first_seen",
    """SELECT user_id AS incident_id, event_type AS urn, arg_min(props, event_id) AS first_props,
       min(event_id) AS first_event FROM events GROUP BY 1, 2""",
)
def merge_first_seen(spark, sf):
    sightings = fx.table(spark, sf, "events").select(
        F.col("user_id").alias("incident_id"), F.col("event_type").alias("urn"),
        F.col("props").alias("first_props"), F.col("event_id").alias("first_event"), "event_id",
    )
    return L.merge_first_seen(sightings, ["incident_id", "urn"], "event_id").drop("event_id")


# --- notes and tags ---------------------------------------------------------------------

_NOTED = """
notes AS (
  SELECT doc_id AS urn, 'inc_' || doc_id AS incident_id, 'fixed' AS text FROM documents WHERE doc_id % 20 = 0),
noted AS (SELECT doc_id AS urn, text AS description, lang, doc_id % 10 = 0 AS tagged FROM documents)"""


def noted_assets(spark, sf) -> DataFrame:
    """Every document as an asset description; each tenth carries the tag."""
    tags = F.when(F.col("doc_id") % 10 == 0, F.array(F.col("lang"), F.lit(K.REMEDIATED_TAG))).otherwise(F.array("lang"))
    return fx.table(spark, sf, "documents").select(
        F.col("doc_id").alias("urn"), F.col("text").alias("description"), tags.alias("tags")
    )


def asset_notes(spark, sf, text: str = "fixed") -> DataFrame:
    """A note on each document."""
    return fx.table(spark, sf, "documents").select(
        F.col("doc_id").alias("urn"), F.concat(F.lit("inc_"), F.col("doc_id")).alias("incident_id"),
        F.lit("2026-08-01").cast("timestamp").alias("ts"), F.lit(text).alias("text"),
    )


def old_notes(spark, sf) -> DataFrame:
    return asset_notes(spark, sf).filter(F.col("urn") % 20 == 0)


@query(
    "E10_note_append",
    sql(_NOTED, """SELECT a.urn, description || chr(10) || chr(10) || '[inc_' || a.urn || '] ' || coalesce(n.text, 'Field: amount') AS description,
        lang || ',incident-remediated' AS tags
        FROM noted a LEFT JOIN notes n ON a.urn = n.urn"""),
)
def note_append(spark, sf):
    once = K.append_notes(old_notes(spark, sf), asset_notes(spark, sf, "Field: amount"))
    return K.render_notes(noted_assets(spark, sf), once).select(
        "urn", "description", F.array_join(K.with_tag(F.col("tags")), ",").alias("tags")
    )


@query("E11_contamination", sql(_NOTED, "SELECT urn FROM noted WHERE urn IN (SELECT urn FROM notes)"))
def contamination(spark, sf):
    return K.contaminated(noted_assets(spark, sf), old_notes(spark, sf)).select("urn")


@query(
    "E12_scrub",
    sql(_NOTED, """SELECT urn, description, lang AS tags, urn IN (SELECT urn FROM notes) AS note_cleared, tagged AS tag_removed FROM noted"""),
)
def scrub(spark, sf):
    return K.scrub(noted_assets(spark, sf), old_notes(spark, sf)).withColumn("tags", F.array_join("tags", ","))


@query(
    "E12_scrub_counts",
    sql(_NOTED + "," + ASSETS, """SELECT (SELECT count(*) FROM noted WHERE urn IN (SELECT urn FROM notes)) AS notes_cleared,
        (SELECT count(*) FROM noted WHERE tagged) AS tags_removed,
        (SELECT count(*) FROM asset_incidents WHERE state = 'ACTIVE') AS incidents_resolved"""),
)
def scrub_counts(spark, sf):
    cleaned = K.scrub(noted_assets(spark, sf), old_notes(spark, sf)).select(
        F.col("note_cleared").cast("int").alias("a"), F.col("tag_removed").cast("int").alias("b"), F.lit(0).alias("c")
    )
    resolved = K.resolve_active(asset_incidents(spark, sf)).select(
        F.lit(0).alias("a"), F.lit(0).alias("b"), F.col("changed").cast("int").alias("c")
    )
    return cleaned.unionByName(resolved).agg(
        F.sum("a").alias("notes_cleared"), F.sum("b").alias("tags_removed"), F.sum("c").alias("incidents_resolved")
    )
