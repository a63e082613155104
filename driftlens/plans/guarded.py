"""Read-only SQL over named tables.

The text is parsed by Catalyst and only its plan is judged: every node of the parsed plan,
subqueries and common table expressions included, must be one of the relational operators
below. Statements, commands, script transformations, table functions and whatever a later
version adds are refused because they are not on the list. After analysis the expressions
are searched for calls that leave the engine.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

RELATIONAL = {
    "Project", "Filter", "Join", "Aggregate", "UnresolvedHaving", "Sort", "Window", "WithWindowDefinition", "Distinct",
    "Union", "Intersect", "Except", "GlobalLimit", "LocalLimit", "Offset", "Pivot", "Unpivot",
    "UnresolvedRelation", "UnresolvedWith", "UnresolvedSubqueryColumnAliases", "SubqueryAlias", "UnresolvedInlineTable",
    "ResolvedInlineTable", "LocalRelation", "OneRowRelation", "LateralJoin",
}
OUTSIDE = ("Reflect", "UDF", "UDAF", "UDTF", "PythonFunction", "ScriptTransformation")


class Refused(ValueError):
    """The text is not a plain query."""


@dataclass
class Result:
    """Rows of a guarded query; with a limit, ``truncated`` says whether more were there."""

    rows: DataFrame
    everything: DataFrame
    limit: int | None

    @property
    def truncated(self) -> bool:
        return self.limit is not None and self.everything.limit(self.limit + 1).count() > self.limit


def _items(seq: JavaObject) -> Iterator[JavaObject]:
    for i in range(seq.size()):
        yield seq.apply(i)


def _name(node: JavaObject) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _expressions(node: JavaObject) -> Iterator[JavaObject]:
    pending = list(_items(node.expressions()))
    while pending:
        one = pending.pop()
        yield one
        pending.extend(_items(one.children()))


def _nodes(plan: JavaObject) -> Iterator[JavaObject]:
    """All nodes of a plan, with those of its subqueries and common table expressions."""
    pending = [plan]
    while pending:
        node = pending.pop()
        yield node
        pending.extend(_items(node.children()))
        if _name(node) == "UnresolvedWith":
            pending.extend(_items(node.innerChildren()))
        for one in _expressions(node):
            if "Subquery" in _name(one) or _name(one) in ("Exists", "ListQuery"):
                try:
                    pending.append(one.plan())
                except Py4JError:
                    continue  # a wrapper; its inner expression is met as a child


def parse(spark: SparkSession, text: str) -> JavaObject:
    """The parsed plan of a plain query, or ``Refused``."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text.strip().removesuffix(";"))
    except AnalysisException as error:
        raise Refused("the text is not one SQL query") from error
    for node in _nodes(plan):
        if _name(node) not in RELATIONAL:
            raise Refused(f"{_name(node)} is not allowed in a read-only query")
    return plan


@contextmanager
def _views(spark: SparkSession, tables: dict[str, DataFrame]) -> Iterator[None]:
    """Tables under their names for the time of one call; views that were there come back."""
    before = {name: spark.table(name) for name in tables if spark.catalog.tableExists(name)}
    key = "spark.sql.runSQLOnFiles"
    files = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
        yield
    finally:
        spark.conf.set(key, files)
        for name in tables:
            spark.catalog.dropTempView(name)
            if name in before and before[name].sparkSession is not None and not spark.catalog.tableExists(name):
                before[name].createOrReplaceTempView(name)


def run_sql(
    spark: SparkSession, text: str, tables: dict[str, DataFrame] | None = None, limit: int | None = None
) -> Result:
    """A validated query over ``tables`` and the session's own; all its rows unless ``limit`` is given."""
    parse(spark, text)
    with _views(spark, tables or {}):
        found = spark.sql(text.strip().removesuffix(";"))
    for node in _nodes(found._jdf.queryExecution().analyzed()):
        for one in _expressions(node):
            if any(word in _name(one) for word in OUTSIDE):
                raise Refused(f"{_name(one)} leaves the engine")
    return Result(found if limit is None else found.limit(limit), found, limit)
