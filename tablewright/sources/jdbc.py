"""Result of a query in a database that has a JDBC driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FETCH_ROWS = 10_000


def read_sql(
    spark: SparkSession,
    url: str,
    query: str,
    partition_column: str | None = None,
    partitions: int = 64,
    **options: str,
) -> DataFrame:
    """Run ``query`` in the database and read its result.

    With a ``partition_column`` (number, date or timestamp) the result is read in
    ``partitions`` ranges over as many connections; the database is first asked
    for its bounds.  Without one a single connection, hence one task, reads it
    all, which suits small results only.
    """
    if not query.strip():
        raise ValueError("a query is needed")
    reader = spark.read.format("jdbc")
    if partition_column is None:
        return reader.options(**jdbc_options(url, query, **options)).load()
    asked = reader.options(**jdbc_options(url, bounds_query(query, partition_column), **options)).load()
    low, high = asked.select(*[F.col(f"`{c}`").cast("string") for c in asked.columns]).first()
    if low is None:  # no rows, or only rows without that value
        return spark.read.format("jdbc").options(**jdbc_options(url, query, **options)).load()
    ranged = jdbc_options(url, query, partition_column, low, high, partitions, **options)
    return spark.read.format("jdbc").options(**ranged).load()


def bounds_query(query: str, column: str) -> str:
    return f"SELECT min({column}) AS low_end, max({column}) AS high_end FROM ({query}) source"


def jdbc_options(
    url: str,
    query: str,
    partition_column: str | None = None,
    low: str | None = None,
    high: str | None = None,
    partitions: int = 1,
    **options: str,
) -> dict[str, str]:
    """Options of the reader; ranges need the query as a table expression."""
    common = {"url": url, "fetchsize": str(FETCH_ROWS), **options}
    if partition_column is None:
        return {**common, "query": query}
    return {
        **common,
        "dbtable": f"({query}) source",
        "partitionColumn": partition_column,
        "lowerBound": str(low),
        "upperBound": str(high),
        "numPartitions": str(partitions),
    }
