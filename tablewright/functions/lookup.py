"""Joins of a large table with a derived, usually small, table.

The size of the derived side is checked before it is broadcast.  Beyond the
bound, keys that hold a large share of the rows are split off and joined by
broadcast (there can only be few of them); the rest shuffles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.columns import ref
from tablewright.session import scratch_path

SMALL_ROWS = 100_000
SMALL_ROW_TEXT = 640  # bytes; with SMALL_ROWS this keeps a small table below 64 MB of text
HOT_SHARE = 1000  # a key is hot when it holds more than 1/1000 of the rows


def small_rows(df: DataFrame, limit: int | None = None) -> list[Row] | None:
    """The rows when they are few and hold little text, otherwise None.

    No more than ``limit`` rows of bounded text reach the driver: a row with more
    text than that arrives as NULL and makes the table count as not small.
    """
    limit = SMALL_ROWS if limit is None else limit
    whole = F.struct(*[ref(c) for c in df.columns])
    whole = F.when(little_text(df, df.columns), whole)
    rows = [r["row"] for r in df.select(whole.alias("row")).limit(limit + 1).collect()]
    return rows if len(rows) <= limit and all(r is not None for r in rows) else None


def little_text(df: DataFrame, columns: list[str]) -> Column:
    """Whether the texts of a row's ``columns`` have few enough bytes for a broadcast."""
    kinds = (T.StringType, T.BinaryType)
    sizes = [F.coalesce(F.octet_length(ref(c)), F.lit(0)).cast("long") for c in columns if isinstance(df.schema[c].dataType, kinds)]
    return reduce(Column.__add__, sizes) <= SMALL_ROW_TEXT if sizes else F.lit(True)


def broadcast_rows(df: DataFrame, rows: list[Row]) -> DataFrame:
    """A broadcast table of already counted rows with the schema of ``df``."""
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once: a few rows as a local table, others written to the shared folder."""
    rows = small_rows(df)
    if rows is not None:
        return df.sparkSession.createDataFrame(rows, df.schema)
    path = scratch_path(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lookup_join(
    big: DataFrame,
    derived: DataFrame,
    keys: list[str],
    how: str = "inner",
    limit: int | None = None,
) -> DataFrame:
    """Join ``big`` with ``derived`` (one row per key): inner, left or left_semi.

    Rows of ``big`` with a NULL key have no partner, as in any equi-join.
    """
    rows = small_rows(derived, limit)
    if rows is not None:
        return big.join(broadcast_rows(derived, rows), keys, how)
    return skewed_join(big, derived, keys, how)


def skewed_join(
    big: DataFrame, derived: DataFrame, keys: list[str], how: str = "inner", hot_keys: list[Row] | None = None
) -> DataFrame:
    """The same join for two large tables: hot keys by broadcast, the rest by shuffle.

    ``hot_keys`` spares counting the keys of ``big`` when they are known.  Rows
    with a NULL key, which a shuffle would send to one task, stay where they are.
    """
    no_key = reduce(Column.__or__, [ref(k).isNull() for k in keys])
    keyed = big.where(~no_key)
    if hot_keys is None:
        hot_keys = _hot_keys(keyed, keys)
    if hot_keys:
        hot = broadcast_rows(keyed.select(*[ref(k) for k in keys]), hot_keys)
        few = F.broadcast(derived.join(hot, keys, "left_semi"))
        hot_part = keyed.join(hot, keys, "left_semi").join(few, keys, how)
        joined = keyed.join(hot, keys, "left_anti").join(derived, keys, how).unionByName(hot_part)
    else:
        joined = keyed.join(derived, keys, how)
    if how != "left":
        return joined
    return joined.unionByName(big.where(no_key), allowMissingColumns=True)


def _hot_keys(keyed: DataFrame, keys: list[str]) -> list[Row]:
    """Keys with more than one ``HOT_SHARE``-th of the rows: fewer than ``HOT_SHARE``.

    Keys of long texts are not among them; they shuffle like all others.
    """
    total = keyed.count()
    counts = keyed.groupBy(*[ref(k) for k in keys]).agg(F.count("*").alias("__n"))
    hot = (F.col("__n") * HOT_SHARE > total) & little_text(keyed, keys)
    return counts.where(hot).select(*[ref(k) for k in keys]).collect()
