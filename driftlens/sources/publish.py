"""Consistent publish of several tables.

A release is a folder of its own. Its tables are written one after the other, each from
what the release has stored so far, and one manifest row, written last, makes all of them
visible at once. A run that breaks off leaves a folder that no manifest row names, and
readers keep the release before it. Running again is harmless: it makes another release.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

MANIFEST = "version bigint, release string, tables array<string>"

#: Builds a table from the tables that its release has stored already.
Step = Callable[[dict[str, DataFrame]], DataFrame]


class NoRelease(LookupError):
    """Nothing has been published in this folder."""


def releases(spark: SparkSession, root: str) -> DataFrame:
    """The manifest: one row per complete release."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def _current(spark: SparkSession, root: str):
    # Two runs may have counted on from the same release; then the name decides for all readers alike.
    return releases(spark, root).orderBy(F.desc("version"), F.desc("release")).first()


def publish(spark: SparkSession, root: str, steps: Mapping[str, Step]) -> int:
    """Writes the tables in order and switches to them; the version of the release."""
    before = _current(spark, root)
    release, stored = uuid.uuid4().hex, {}
    for name, step in steps.items():
        path = f"{root}/{release}/{name}"
        built = step(dict(stored))
        built.write.mode("error").option("compression", "zstd").parquet(path)
        stored[name] = spark.read.schema(built.schema).parquet(path)
    version = (before["version"] if before else 0) + 1
    row = spark.createDataFrame([(version, release, list(steps))], MANIFEST)
    row.coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    return version


def read(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """All tables of the present release."""
    row = _current(spark, root)
    if row is None:
        raise NoRelease(root)
    return {name: spark.read.parquet(f"{root}/{row['release']}/{name}") for name in row["tables"]}
