"""Asset catalog: loading, context, search, health, schema changes, clean-up."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

def explode_column_maps(edges: DataFrame, maps: str = "column_map") -> DataFrame:
    """Rows (source, target, source_col, target_col) from a map downstream -> upstreams."""
    return edges.select("source", "target", F.explode(maps).alias("target_col", "_ups")).select(
        "source", "target", F.explode("_ups").alias("source_col"), "target_col"
    )


def load_steps(source: DataFrame, edges: DataFrame) -> dict[str, Callable[[dict[str, DataFrame]], DataFrame]]:
    """The catalog's tables, in the order in which a release stores them (see ``sources.publish``).

    ``source`` has one row per asset (urn, name, description, owners, tags, properties) and
    ``edges`` a column map each. Lists become rows; owners, tags and properties hold only
    what belongs to a stored asset.
    """

    def of_asset(rows: Callable[[DataFrame], DataFrame]) -> Callable[[dict[str, DataFrame]], DataFrame]:
        # Whole assets meet the stored ones: once dealt by urn, their lists unfold and lose repeats in place.
        return lambda stored: rows(source.join(stored["assets"].select("urn"), "urn", "left_semi")).distinct()

    return {
        "assets": lambda stored: source.select("urn", "name", "description").dropDuplicates(["urn"]),
        "owners": of_asset(lambda own: own.select("urn", F.explode("owners").alias("owner"))),
        "tags": of_asset(lambda own: own.select("urn", F.explode("tags").alias("tag"))),
        "properties": of_asset(lambda own: own.select("urn", F.explode("properties").alias("key", "value"))),
        "edges": lambda stored: explode_column_maps(edges),
    }


def introspect(tables: dict[str, DataFrame]) -> DataFrame:
    """(urn, field, type, position) of the given tables, read from their schemas."""
    spark = next(iter(tables.values())).sparkSession
    rows = [
        (name, f.name, f.dataType.simpleString(), i)
        for name, df in tables.items()
        for i, f in enumerate(df.schema.fields)
    ]
    return spark.createDataFrame(rows, "urn string, field string, type string, position int")


def document_fields(fields: DataFrame, docs: DataFrame) -> DataFrame:
    """Fields with their documentation, empty where there is none."""
    return fields.join(docs.select("urn", "field", F.col("description").alias("_doc")), ["urn", "field"], "left").select(
        *fields.columns, F.coalesce("_doc", F.lit("")).alias("description")
    )


def filled(value: Column) -> Column:
    """The value, with the empty string counting as missing."""
    return F.when(value != "", value)


def field_docs(fields: DataFrame) -> DataFrame:
    """The edited field description overrides the ingested one."""
    return fields.withColumn(
        "description", F.coalesce(filled(F.col("editable_description")), F.col("description"))
    ).drop("editable_description")


def asset_context(assets: DataFrame, fields: DataFrame, owners: DataFrame) -> DataFrame:
    """One row per asset with its fields and owners as arrays.

    The arrays follow the width of an asset's schema and its owner list.
    """
    columns = field_docs(fields).groupBy("urn").agg(
        F.array_sort(F.collect_list(F.struct("field", "type", "description"))).alias("fields")
    )
    people = owners.groupBy("urn").agg(F.array_sort(F.collect_set("owner")).alias("owners"))
    described = assets.withColumn(
        "description", F.coalesce(filled(F.col("editable_description")), F.col("description"))
    ).drop("editable_description")
    return described.join(columns, "urn", "left").join(people, "urn", "left")


def query_terms(text: str) -> list[str]:
    """Distinct lower-case words of a query, in order; a word is letters and digits of any script."""
    return list(dict.fromkeys(re.findall(r"[^\W_]+", text.lower())))


def has_term(text: Column, term: str) -> Column:
    """Whole-word match; the plain substring test spares most rows the pattern."""
    return F.contains(text, F.lit(term)) & text.rlike(rf"(^|[^\p{{L}}\p{{N}}]){term}($|[^\p{{L}}\p{{N}}])")


def search(assets: DataFrame, text: str, limit: int) -> DataFrame:
    """Assets by number of query terms found in name or description, best first.

    Misses are dropped after the top-k, where they can only be at its end: a filter
    before it would read every text a second time.
    """
    body = F.lower(F.concat_ws(" ", "name", "description"))
    score = F.lit(0)
    for term in query_terms(text):
        score = score + has_term(body, term).cast("int")
    return (
        assets.select("urn", "name", score.alias("score"))
        .orderBy(F.desc("score"), "urn")
        .limit(limit)
        .filter(F.col("score") > 0)
    )


def estate_health(assets: DataFrame, incidents: DataFrame, checks: DataFrame) -> DataFrame:
    """Assets with an active incident or a failing check; health is a list of entries."""
    active = incidents.filter(F.col("state") == "ACTIVE").groupBy("urn").agg(
        F.count(F.lit(1)).alias("n")
    ).select("urn", F.lit("INCIDENTS").alias("type"), F.concat("n", F.lit(" active incidents")).alias("message"))
    failing = checks.filter(~F.col("passed")).groupBy("urn").agg(
        F.count(F.lit(1)).alias("n")
    ).select("urn", F.lit("ASSERTIONS").alias("type"), F.concat("n", F.lit(" failing checks")).alias("message"))
    # At most one entry per type and asset reaches the list.
    health = active.unionByName(failing).groupBy("urn").agg(
        F.array_sort(F.collect_list(F.struct("type", F.lit("FAIL").alias("status"), "message"))).alias("health")
    )
    return assets.select("urn", "name").join(health, "urn")


def enrich(nodes: DataFrame, assets: DataFrame, owners: DataFrame, health: DataFrame) -> DataFrame:
    """Names, owners and health for a whole frontier in one pass."""
    wanted = nodes.select("urn").distinct()
    people = owners.join(wanted, "urn", "left_semi").groupBy("urn").agg(
        F.array_sort(F.collect_set("owner")).alias("owners")
    )
    return (
        assets.select("urn", "name").join(wanted, "urn", "left_semi")
        .join(people, "urn", "left")
        .join(health.select("urn", "health"), "urn", "left")
    )


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` in as many parts as the session shuffles into.

    Names compress so well that parts merged by their stored bytes are many times larger once
    a task sorts them; a given number of parts is not merged.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def schema_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Fields added, removed or retyped between two snapshots."""
    old = dealt(before.select("urn", "field", F.col("type").alias("old_type")), "urn", "field")
    new = dealt(after.select("urn", "field", F.col("type").alias("new_type")), "urn", "field")
    change = (
        F.when(F.col("old_type").isNull(), "added")
        .when(F.col("new_type").isNull(), "removed")
        .when(F.col("old_type") != F.col("new_type"), "retyped")
    )
    return old.join(new, ["urn", "field"], "full_outer").withColumn("change", change).filter(
        F.col("change").isNotNull()
    )


def summary(nodes: DataFrame, edges: DataFrame, hits: DataFrame, fields: DataFrame) -> DataFrame:
    """Round-trip summary: search hits, nodes, edges, column-mapped edges, contract.

    Every part is one count; they meet as rows of a union and are summed.
    """
    zero = F.lit(0).cast("bigint")

    def part(df: DataFrame, **values: Column) -> DataFrame:
        names = ("search_hits", "lineage_nodes", "lineage_edges", "column_mapped_edges", "contract_fields")
        return df.agg(*[values.get(n, zero).alias(n) for n in names])

    parts = [
        part(hits, search_hits=F.count(F.lit(1))),
        part(nodes, lineage_nodes=F.count(F.lit(1))),
        part(edges, lineage_edges=F.count(F.lit(1)), column_mapped_edges=F.count_if(F.size("columns") > 0)),
        part(fields, contract_fields=F.count_if(F.lower("description").contains("major currency units"))),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    sums = rows.agg(*[F.sum(c).alias(c) for c in rows.columns])
    return sums.withColumn("contract_present", F.col("contract_fields") > 0).drop("contract_fields")


# --- incident notes and tags ----------------------------------------------------------

NOTE_KEY = ["urn", "incident_id"]
REMEDIATED_TAG = "incident-remediated"


def append_notes(notes: DataFrame, new: DataFrame) -> DataFrame:
    """Notes (urn, incident_id, ts, text) with the new ones of incidents that have none yet.

    Of several new notes for one incident and asset the earliest is taken, so appending
    the same batch again changes nothing.
    """
    first = new.groupBy(*NOTE_KEY).agg(F.min(F.struct("ts", "text")).alias("_n")).select(*NOTE_KEY, "_n.ts", "_n.text")
    return notes.unionByName(first.join(notes.select(*NOTE_KEY), NOTE_KEY, "left_anti"))


def with_tag(tags: Column, tag: str = REMEDIATED_TAG) -> Column:
    return F.array_union(F.coalesce(tags, F.array().cast("array<string>")), F.array(F.lit(tag)))


def render_notes(assets: DataFrame, notes: DataFrame) -> DataFrame:
    """Assets whose description shows their notes in order of time; nothing is cut.

    The array follows the incidents of one asset.
    """
    line = F.concat(F.lit("["), "incident_id", F.lit("] "), "text")
    shown = notes.groupBy("urn").agg(F.array_sort(F.collect_list(F.struct("ts", "incident_id", line.alias("line")))).alias("_notes"))
    body = F.concat_ws("\n\n", F.coalesce("description", F.lit("")), F.array_join(F.transform("_notes", lambda n: n["line"]), "\n\n"))
    return assets.join(shown, "urn", "left").withColumn(
        "description", F.when(F.col("_notes").isNull(), F.col("description")).otherwise(body)
    ).drop("_notes")


def contaminated(assets: DataFrame, notes: DataFrame) -> DataFrame:
    """Assets that an incident left a note on."""
    return assets.join(notes.select("urn").distinct(), "urn", "left_semi")


def scrub(assets: DataFrame, notes: DataFrame, tag: str = REMEDIATED_TAG) -> DataFrame:
    """Assets as they are without notes and tag; flags say what goes. Descriptions were never touched."""
    noted = notes.select("urn").distinct().withColumn("_noted", F.lit(True))
    return assets.join(noted, "urn", "left").select(
        "urn", "description",
        F.array_remove("tags", tag).alias("tags"),
        F.coalesce("_noted", F.lit(False)).alias("note_cleared"),
        F.coalesce(F.array_contains("tags", tag), F.lit(False)).alias("tag_removed"),
    )


def scrub_notes(notes: DataFrame, assets: DataFrame) -> DataFrame:
    """Notes without those of the given assets."""
    return notes.join(assets.select("urn").distinct(), "urn", "left_anti")


def resolve_active(incidents: DataFrame) -> DataFrame:
    """Active incidents become resolved; ``changed`` marks them for counting."""
    active = F.col("state") == "ACTIVE"
    return incidents.withColumn("changed", active).withColumn(
        "state", F.when(active, "RESOLVED").otherwise(F.col("state"))
    )
