"""Value counts of several columns from one scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import is_nested, present, ref
from tablewright.functions.reports import blocks

SET_BLOCK = 8  # each block reads its own columns only, so small blocks cost no extra reading


def value_counts(df: DataFrame, columns: list[str]) -> list[tuple[list[str], DataFrame]]:
    """Counts per column and value as ``(*columns, __column, __n)``.

    One grouping set per column: values keep their type, counting starts before
    the shuffle, and a frequent value costs one row per task.  Only the member
    column of a row is filled.  Wide tables give several blocks.
    """
    for name in columns:
        if is_nested(df.schema[name].dataType):
            raise ValueError(f"values of nested column {name!r} cannot be counted")
    parts = []
    for block in blocks(columns, SET_BLOCK):
        narrow = df.select(*[present(df.schema[c]).alias(c) for c in block])
        refs = [ref(c) for c in block]
        if len(block) == 1:
            counted = narrow.groupBy(*refs).agg(F.count("*").alias("__n")).withColumn("__column", F.lit(block[0]))
        else:
            member = F.create_map(
                *[x for i, c in enumerate(block) for x in (F.lit(_set_id(i, len(block))), F.lit(c))]
            )
            counted = (
                narrow.groupingSets([(r,) for r in refs], *refs)
                .agg(F.grouping_id().alias("__set"), F.count("*").alias("__n"))
                .withColumn("__column", member[F.col("__set")])
                .drop("__set")
            )
        parts.append((block, counted))
    return parts


def text_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Value counts in long form: ``(column, value string, n)``; missing is NULL."""
    return reduce(
        DataFrame.unionByName,
        [
            counted.select(
                F.col("__column").alias("column"),
                F.coalesce(*[ref(c).cast("string") for c in block]).alias("value"),
                F.col("__n").alias("n"),
            )
            for block, counted in value_counts(df, columns)
        ],
    )


def most_frequent(df: DataFrame, columns: list[str]) -> dict[str, tuple[str | None, int]]:
    """Most frequent value that is not missing, smallest on ties, per column.

    The value comes back as Spark's string form of it: casting that string to
    the column's type restores it.
    """
    found: dict[str, tuple[str | None, int]] = {c: (None, 0) for c in columns}
    for block, counted in value_counts(df, columns):
        filled = reduce(Column.__or__, [ref(c).isNotNull() for c in block])
        best = (
            counted.where(filled)
            .groupBy("__column")
            .agg(
                F.min_by(
                    F.struct(F.coalesce(*[ref(c).cast("string") for c in block]).alias("value"), "__n"),
                    F.struct(-F.col("__n"), *[ref(c) for c in block]),
                ).alias("best")
            )
            .collect()
        )
        for row in best:
            found[row["__column"]] = (row["best"]["value"], row["best"]["__n"])
    return found


def _set_id(index: int, width: int) -> int:
    """grouping_id of the set holding only column ``index``: all other bits set."""
    return (1 << width) - 1 - (1 << (width - 1 - index))
