"""Registry of queries, and the tables they start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with the SQL for the same result."""

    def register(run: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = sql
        return run

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flagship(spark: SparkSession, data_dir: str) -> DataFrame:
    """Filter chain into a bar chart: the usual way through an analysis."""
    return _QUERIES["f8_filter_chain_bar"](spark, data_dir)


def table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{data_dir.rstrip('/')}/{name}.parquet")


def orders_with_gaps(spark: SparkSession, data_dir: str) -> DataFrame:
    """Orders with missing prices and states, which the tables themselves lack."""
    return table(spark, data_dir, "orders").selectExpr(
        "o_orderkey",
        "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price",
        "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS status",
        "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_custkey AS BIGINT) END AS customer",
    )


GAPS_SQL = """
WITH gaps AS (
  SELECT o_orderkey,
         CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price,
         CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS status,
         CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_custkey AS BIGINT) END AS customer
  FROM orders)
"""


def order_days(spark: SparkSession, data_dir: str) -> DataFrame:
    """A narrow projection of orders, in which many rows are equal."""
    return table(spark, data_dir, "orders").selectExpr(
        "o_orderstatus", "o_orderpriority", "date_format(o_orderdate, 'yyyy-MM-dd') AS order_day"
    )


DAYS_SQL = """
WITH days AS (
  SELECT o_orderstatus, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d') AS order_day FROM orders)
"""


def line_numbers(spark: SparkSession, data_dir: str) -> DataFrame:
    return table(spark, data_dir, "lineitem").select(
        "l_quantity", "l_extendedprice", "l_discount", "l_tax"
    )


def flagged_lines(spark: SparkSession, data_dir: str) -> DataFrame:
    """Lines with a boolean column, which the tables themselves lack."""
    return table(spark, data_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_linestatus", "l_quantity", "l_returnflag = 'R' AS returned"
    )
