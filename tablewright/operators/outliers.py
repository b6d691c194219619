"""Outliers by the interquartile range: outside Q1 - 1.5 IQR or Q3 + 1.5 IQR."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import number, numeric_names, ref
from tablewright.functions.quantiles import column_quantiles
from tablewright.functions.reports import row_report

# Fixed value: width of the fences in interquartile ranges.
FENCE = 1.5


def fences(q1: float, q3: float) -> tuple[float, float]:
    reach = FENCE * (q3 - q1)
    return q1 - reach, q3 + reach


def iqr_fences(
    df: DataFrame, columns: list[str], approx: bool = False
) -> dict[str, tuple[float, float] | None]:
    """Lower and upper fence per column; None for a column without values."""
    quartiles = column_quantiles(df, columns, [0.25, 0.75], approx=approx)
    return {c: fences(*q) if q else None for c, q in quartiles.items()}


def outlier_summary(df: DataFrame, columns: list[str] | None = None, approx: bool = False) -> DataFrame:
    """``(column, num_outliers, pct_outliers)``; the share counts all rows."""
    names = numeric_names(df, columns)
    limits = iqr_fences(df, names, approx)
    rows = []
    for name in names:
        value = number(df, name)
        if limits[name] is None:
            count = F.count_if(F.lit(False))
        else:
            low, high = limits[name]
            count = F.count_if((value < low) | (value > high))
        share = F.coalesce(F.try_divide(count * 100.0, F.count("*")), F.lit(0.0))
        rows.append({"column": F.lit(name), "num_outliers": count, "pct_outliers": share})
    return row_report(df, rows, "column string, num_outliers bigint, pct_outliers double")


def remove_outliers(
    df: DataFrame, columns: list[str] | None = None, simultaneous: bool = False, approx: bool = False
) -> DataFrame:
    """Keep rows inside the fences of every column; a missing value is not inside.

    Column by column: the fences of a column are taken from the rows that the
    columns before it left.  Only the fences come back to the driver; the result
    is the base table with one range predicate per column, which Parquet can
    prune.  ``simultaneous`` takes all fences from the whole table instead.
    """
    names = numeric_names(df, columns)
    together = iqr_fences(df, names, approx) if simultaneous else {}
    kept = df
    for name in names:
        limits = together[name] if simultaneous else iqr_fences(kept, [name], approx)[name]
        if limits is None:
            return kept.where(F.lit(False))
        kept = kept.where(ref(name).between(*limits))
    return kept
