"""One scan for many columns.

A loop with one action per column would scan a large table once per column.
These helpers put the aggregates of all columns into one ``agg``; wide tables
are cut into blocks so that a generated stage stays compilable.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 200


def blocks(items: list, size: int) -> list[list]:
    return [items[i : i + size] for i in range(0, len(items), size)]


def statistics(df: DataFrame, aggregates: dict[str, Column]) -> dict[str, object]:
    """Evaluate the aggregates and return them by name: one row, a bounded result."""
    found: dict[str, object] = {}
    for block in blocks(list(aggregates), BLOCK):
        row = df.agg(*[aggregates[key].alias(f"s{i}") for i, key in enumerate(block)]).first()
        found.update(zip(block, row))
    return found


def row_report(df: DataFrame, rows: list[dict[str, Column]], schema: str) -> DataFrame:
    """Lazy report: every dict of aggregates becomes one row, all from one scan.

    ``schema`` is the DDL of the report; it also fixes the column order.
    """
    if not rows:
        return df.sparkSession.createDataFrame([], schema)
    per_block = max(1, BLOCK // len(rows[0]))
    parts = []
    for block in blocks(rows, per_block):
        packed = F.array(*[F.struct(*[v.alias(k) for k, v in row.items()]) for row in block])
        parts.append(
            df.agg(packed.cast(f"array<struct<{_struct_ddl(schema)}>>").alias("report")).select(
                F.inline("report")
            )
        )
    return reduce(DataFrame.unionByName, parts)


def _struct_ddl(schema: str) -> str:
    return ",".join(":".join(part.split()) for part in schema.split(","))
