"""Names, layers and fields read out of dataset URNs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Name prefixes and the layer each one means.
LAYER_PREFIXES = {
    "raw_": "source",
    "stg_": "staging",
    "fct_": "marts",
    "dim_": "marts",
    "exec_": "metric",
}

# URN patterns of the metadata catalog.
DATASET_URN = r"^urn:li:dataset:\(urn:li:dataPlatform:([^,]+),(.+),[^,]+\)$"
PLATFORM_URN = r"^urn:li:dataset:\(urn:li:dataPlatform:([^,]+),"
FIELD_URN = r"^urn:li:schemaField:\((.+),([^,]+)\)$"


def dataset_name(urn: Column) -> Column:
    """Dataset name inside the URN; the URN itself when it has another shape."""
    return F.when(urn.rlike(DATASET_URN), F.regexp_extract(urn, DATASET_URN, 2)).otherwise(urn)


def dataset_platform(urn: Column) -> Column:
    return F.when(urn.rlike(PLATFORM_URN), F.regexp_extract(urn, PLATFORM_URN, 1)).otherwise("unknown")


def field_parts(urn: Column) -> tuple[Column, Column]:
    """(dataset URN, field) of a schema-field URN; NULLs when it is not one."""
    hit = urn.rlike(FIELD_URN)
    return (
        F.when(hit, F.regexp_extract(urn, FIELD_URN, 1)),
        F.when(hit, F.regexp_extract(urn, FIELD_URN, 2)),
    )


def layer_of(name: Column) -> Column:
    """Warehouse layer by name prefix, then by the words metric / dashboard, else marts."""
    last = F.substring_index(F.lower(name), ".", -1)
    layer = F.when(last.startswith("raw_"), LAYER_PREFIXES["raw_"])
    for prefix, value in list(LAYER_PREFIXES.items())[1:]:
        layer = layer.when(last.startswith(prefix), value)
    return layer.when(last.contains("metric") | last.contains("dashboard"), "metric").otherwise("marts")


def urn_tail_name(urn: Column) -> Column:
    """Second-last comma part (the dataset name), or the whole value without a comma."""
    parts = F.split(urn, ",")
    return F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(urn)
