"""A SELECT text over the current table, which it sees as ``df``.

What a text may read is decided on the plan that Spark's own parser makes of it, before
any name is looked up: nodes are walked with the ``WITH`` names in their scope, and only
kinds of nodes that are known to read nothing else may occur.
"""

from __future__ import annotations

import re
import uuid
import warnings
from collections.abc import Iterator

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from tablewright.functions.columns import normalise_missing

TABLE = "df"
_LEADING_COMMENTS = re.compile(r"\A(?:\s+|--[^\n]*(?:\n|\Z)|/\*.*?\*/)*", re.DOTALL)
#: Nodes of a parsed query that read no table by themselves.  Others are refused: names made
#: up at run time, other versions of a table, rows piped through a program.
_PLAIN_NODES = frozenset(
    """Aggregate CTERelationDef Deduplicate Distinct Except Filter Generate GlobalLimit Intersect Join LateralJoin
    LimitAll LocalLimit LocalRelation Offset OneRowRelation PipeOperator Pivot Project Repartition RepartitionByExpression
    Sample Sort SubqueryAlias Tail Union UnresolvedHaving UnresolvedHint UnresolvedInlineTable UnresolvedOrdinal
    UnresolvedSubqueryColumnAliases UnresolvedTVFAliases UnresolvedTableValuedFunction Unpivot Window
    WithWindowDefinition""".split()
)
#: Functions that call any method of the virtual machine.
_REFUSED_FUNCTIONS = frozenset(["reflect", "try_reflect", "java_method"])


def sql_select(
    df: DataFrame, text: str | None, on_error: str = "raise", nan_as_null: bool = True
) -> DataFrame:
    """Result of one SELECT (or WITH ... SELECT) on ``df``; blank text changes nothing.

    The text is placed in a subquery: commands and several statements do not
    parse there, so nothing but a query can run; one semicolon may end the text.
    Files, other tables, programs and names made up at run time are refused.  ``on_error="original"`` warns and returns
    the table unchanged instead of raising.  The text sees NaN as
    NULL; turn that off for a table without NaN to let Parquet test conditions on
    floating-point columns.
    """
    if on_error not in ("raise", "original"):
        raise ValueError(f"unknown on_error: {on_error!r}")
    if not text or not text.strip():
        return df
    try:
        return _select(normalise_missing(df) if nan_as_null else df, text)
    except (ValueError, PySparkException) as error:
        if on_error == "raise":
            raise
        warnings.warn(f"SQL query not applied: {error}", stacklevel=2)
        return df


def _select(df: DataFrame, text: str) -> DataFrame:
    body = _LEADING_COMMENTS.sub("", text).strip().removesuffix(";")
    if re.match(r"(select|with)\b", body, re.IGNORECASE) is None:
        raise ValueError("only SELECT statements are permitted")
    spark = df.sparkSession
    _check(spark, body)
    # Every text has a view name of its own, so texts of several threads do not meet.
    view = f"{TABLE}_{uuid.uuid4().hex}"
    df.createTempView(view)
    try:
        return spark.sql(f"WITH {TABLE} AS (SELECT * FROM {view}) SELECT * FROM (\n{body}\n) AS selected")
    finally:  # the result is already bound to the table, not to the name
        spark.catalog.dropTempView(view)


def _check(spark: SparkSession, body: str) -> None:
    """Raise when the text reads anything but ``df`` and its own ``WITH`` tables."""
    parser = spark._jsparkSession.sessionState().sqlParser()
    _Walk(spark).plan(parser.parsePlan(f"SELECT * FROM (\n{body}\n) AS selected"), frozenset([TABLE]))


def _listed(seq) -> Iterator:
    iterator = seq.iterator()
    while iterator.hasNext():
        yield iterator.next()


class _Walk:
    """Visits a parsed plan and the plans inside its expressions, with the table names in scope."""

    def __init__(self, spark: SparkSession) -> None:
        package = "org.apache.spark.sql.catalyst.expressions"
        self.holds_plan = spark._jvm.java.lang.Class.forName(f"{package}.PlanExpression").isInstance
        self.cased = spark.conf.get("spark.sql.caseSensitive") == "true"

    def name(self, text: str) -> str:
        return text if self.cased else text.lower()

    def plan(self, node, scope: frozenset[str]) -> None:
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedWith":
            scope = self.with_tables(node, scope)
        elif kind == "UnresolvedRelation":
            self.relation(node, scope)
        elif kind not in _PLAIN_NODES:
            raise ValueError(f"only plain queries over {TABLE} are permitted, not {kind}")
        for expression in _listed(node.expressions()):
            self.expression(expression, scope)
        for child in _listed(node.children()):
            self.plan(child, scope)

    def with_tables(self, node, scope: frozenset[str]) -> frozenset[str]:
        """The scope behind a ``WITH``: a name is known to what follows it, and to itself if recursive."""
        for relation in _listed(node.cteRelations()):
            own = scope | {self.name(relation._1())}
            self.plan(relation._2(), own if node.allowRecursion() else scope)
            scope = own
        return scope

    def relation(self, node, scope: frozenset[str]) -> None:
        parts = list(_listed(node.multipartIdentifier()))
        if len(parts) != 1 or self.name(parts[0]) not in scope or node.isStreaming():
            raise ValueError(f"only {TABLE} can be read, not {'.'.join(parts)}")

    def expression(self, node, scope: frozenset[str]) -> None:
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedFunction" and list(_listed(node.nameParts()))[-1].lower() in _REFUSED_FUNCTIONS:
            raise ValueError("functions that call methods of the virtual machine are not permitted")
        if kind == "ExpressionWithUnresolvedIdentifier":
            raise ValueError("names made up by an expression are not permitted")
        if self.holds_plan(node):
            self.plan(node.plan(), scope)
        for child in _listed(node.children()):
            self.expression(child, scope)
