"""Missing values and duplicate rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import (
    check_names,
    is_float,
    is_integer,
    is_nested,
    missing,
    normalise_missing,
    number,
    numeric_names,
    present,
    ref,
)
from tablewright.functions.quantiles import column_quantiles
from tablewright.functions.reports import row_report, statistics
from tablewright.functions.values import most_frequent
from tablewright.session import delete_path, scratch_path

STRATEGIES = ("mean", "median", "mode", "constant", "drop")
COPIES_PER_TASK_ROW = 100_000
_PRINT = ["__print_a", "__print_b"]
#: Bits of the map of repeated fingerprints: for each of them, and at most (16 MB).
BITS_PER_PRINT, MOST_BITS = 32, 1 << 27


def missing_summary(df: DataFrame) -> DataFrame:
    """``(column, missing_count, missing_pct)``; the share is NULL on an empty table."""
    rows = []
    for f in df.schema.fields:
        count = F.count_if(missing(f))
        rows.append(
            {
                "column": F.lit(f.name),
                "missing_count": count,
                "missing_pct": F.try_divide(count * 100.0, F.count("*")),
            }
        )
    return row_report(df, rows, "column string, missing_count bigint, missing_pct double")


def fill_missing(
    df: DataFrame, strategy: str = "mean", value: object = None, approx: bool = False
) -> DataFrame:
    """Fill or drop missing values by one of ``STRATEGIES``; ``approx`` concerns the median."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown missing value strategy: {strategy!r}")
    if strategy == "drop":
        return drop_missing(df)
    if strategy == "constant":
        return fill_constant(df, value)
    if strategy == "mode":
        return fill_mode(df)
    return fill_mean(df) if strategy == "mean" else fill_median(df, approx)


def drop_missing(df: DataFrame) -> DataFrame:
    """Keep rows without any missing value."""
    keep = [~missing(f) for f in df.schema.fields]
    for predicate in keep:
        df = df.where(predicate)
    return df


def fill_mean(df: DataFrame) -> DataFrame:
    """Numeric columns get their mean."""
    names = numeric_names(df)
    aggregates = {}
    for name in names:
        aggregates["mean", name] = F.avg(number(df, name))
        aggregates["gaps", name] = F.count_if(missing(df.schema[name]))
    found = statistics(df, aggregates) if names else {}
    fills = {c: found["mean", c] for c in names if found["gaps", c]}
    return _fill_numbers(df, fills)


def fill_median(df: DataFrame, approx: bool = False) -> DataFrame:
    """Numeric columns get their median: the midpoint of the two middle values, unless ``approx``."""
    names = numeric_names(df)
    aggregates = {}
    for name in names:
        aggregates["values", name] = F.count(number(df, name))
        aggregates["gaps", name] = F.count_if(missing(df.schema[name]))
    found = statistics(df, aggregates) if names else {}
    with_gaps = [c for c in names if found["gaps", c]]
    counts = {c: found["values", c] for c in with_gaps}
    medians = column_quantiles(df, with_gaps, [0.5], approx=approx, counts=counts)
    return _fill_numbers(df, {c: medians[c] and medians[c][0] for c in with_gaps})


def _fill_numbers(df: DataFrame, fills: dict[str, float | None]) -> DataFrame:
    """Fill numeric gaps; a filled integer column becomes double, as its mean may be one."""
    filled = {}
    for name, value in fills.items():
        if value is None:
            continue
        field = df.schema[name]
        target = "double" if is_integer(field.dataType) else field.dataType
        filled[name] = F.coalesce(present(field).cast(target), F.lit(value).cast(target))
    return df.withColumns(filled) if filled else df


def fill_mode(df: DataFrame) -> DataFrame:
    """Every column gets its most frequent value, the smallest one on ties."""
    flat = [f for f in df.schema.fields if not is_nested(f.dataType)]
    gaps = statistics(df, {f.name: F.count_if(missing(f)) for f in flat}) if flat else {}
    with_gaps = [f for f in flat if gaps[f.name]]
    if not with_gaps:
        return df
    modes = most_frequent(df, [f.name for f in with_gaps])
    filled = {}
    for f in with_gaps:
        value, _ = modes[f.name]
        if value is not None:
            filled[f.name] = F.coalesce(present(f), F.lit(value).cast(f.dataType))
    return df.withColumns(filled) if filled else df


def fill_constant(df: DataFrame, value: object) -> DataFrame:
    """Every column whose type can hold the constant gets it; types never change."""
    if value is None:
        raise ValueError("a constant is needed")
    text = str(value)
    fields = [f for f in df.schema.fields if not is_nested(f.dataType)]
    fitting = df.sparkSession.range(1).select(
        *[F.lit(text).try_cast(f.dataType).isNotNull().alias(f"c{i}") for i, f in enumerate(fields)]
    )
    fits = dict(zip([f.name for f in fields], fitting.first() or []))
    filled = {
        f.name: F.coalesce(present(f), F.lit(text).cast(f.dataType)) for f in fields if fits[f.name]
    }
    return df.withColumns(filled) if filled else df


def duplicate_groups(df: DataFrame, by_fingerprint: bool = False) -> DataFrame:
    """Every row that occurs more than once, with ``copies``.  Missing equals missing.

    Copies are counted before the shuffle, so a row repeated any number of times
    stays cheap.  ``by_fingerprint`` is for wide tables of mostly different rows: a
    first scan shuffles 128-bit fingerprints only, and whole rows meet only where a
    fingerprint may occur twice; there they decide.
    """
    check_names(df.columns, ["copies"])
    return _repeated(df, by_fingerprint).withColumnRenamed("__copies", "copies")


def _repeated(df: DataFrame, by_fingerprint: bool = False) -> DataFrame:
    marked = _marked(df) if by_fingerprint else None
    rows = normalise_missing(df) if marked is None else marked.where("__again")
    counted = rows.groupBy(*[ref(c) for c in df.columns]).agg(F.count("*").alias("__copies"))
    return counted.where("__copies > 1")


def _fingerprint(df: DataFrame) -> list[Column]:
    """Two hashes over all columns that agree wherever the rows do."""
    # Zero has two signs, which compare as equal but hash apart.
    whole = [ref(f.name) + F.lit(0.0).cast(f.dataType) if is_float(f.dataType) else ref(f.name) for f in df.schema.fields]
    # A NULL leaves a hash as it was: where they stand is hashed, too.
    gaps = [ref(f.name).isNull() for f in df.schema.fields]
    return [F.xxhash64(*whole, *gaps), F.xxhash64(F.lit("second"), *gaps, *reversed(whole))]


def _marked(df: DataFrame) -> DataFrame | None:
    """The rows with ``__again``: whether their fingerprint may occur more than once.

    It is true for every such row and for a few others, as places of a bit map stand for
    the fingerprints; whole rows decide among them.  None where whole rows are the better
    key: nested ones, or most rows repeated.
    """
    if any(is_nested(f.dataType) for f in df.schema.fields):
        return None
    plain = normalise_missing(df)
    printed = plain.withColumns(dict(zip(_PRINT, _fingerprint(plain))))
    counted = printed.groupBy(*_PRINT).agg(F.count("*").alias("__n"))
    path = scratch_path(df.sparkSession, "fingerprints")
    counted.where("__n > 1").write.parquet(path)
    again = df.sparkSession.read.parquet(path)
    sizes = again.agg(F.count("*").alias("prints"), F.sum("__n").alias("rows")).first()
    if 2 * (sizes["rows"] or 0) > df.count():
        return None
    bits = _bit_map(again, sizes["prints"])
    delete_path(df.sparkSession, path)
    sent = df.sparkSession.sparkContext.broadcast(bits)

    def marked(first: pd.Series) -> pd.Series:
        place = _place(first.to_numpy(), sent.value)
        return pd.Series((sent.value[place >> 3] >> (place & 7).astype("uint8")) & 1 == 1)

    return printed.withColumn("__again", F.pandas_udf(marked, "boolean")(_PRINT[0]))


def _place(prints: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return np.mod(prints, 8 * len(bits))


def _bit_map(prints: DataFrame, count: int) -> np.ndarray:
    """One bit for each place that a fingerprint falls on; its size is bounded, so many may share one."""
    size = 1 << max(10, min(MOST_BITS, int(BITS_PER_PRINT * count)).bit_length() - 1)
    place = F.pmod(F.col(_PRINT[0]), F.lit(size))
    words = prints.select(F.shiftright(place, 5).alias("word"), F.pow(F.lit(2.0), place % 32).cast("long").alias("bit"))
    words = words.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    found = words.toPandas()
    bits = np.zeros(size // 32, dtype="<u4")
    bits[found["word"].to_numpy(dtype="int64")] = found["bits"].to_numpy(dtype="int64")
    return bits.view("uint8")


def duplicate_count(df: DataFrame, by_fingerprint: bool = False) -> DataFrame:
    """Number of rows that have at least one equal row, all members counted."""
    return _repeated(df, by_fingerprint).agg(F.coalesce(F.sum("__copies"), F.lit(0)).cast("bigint").alias("duplicates"))


def duplicate_rows(df: DataFrame, by_fingerprint: bool = False) -> DataFrame:
    """All members of the duplicate groups.

    The copies of one row are written out in portions that are spread over the
    tasks, so that a very frequent row does not fall to one of them.
    """
    names = [ref(c) for c in df.columns]
    portions = F.ceil(F.col("__copies") / F.lit(COPIES_PER_TASK_ROW)).cast("bigint")
    portion = F.least(
        F.lit(COPIES_PER_TASK_ROW).cast("bigint"), F.col("__copies") - F.col("__portion") * COPIES_PER_TASK_ROW
    )
    return (
        _repeated(df, by_fingerprint)
        .withColumn("__portion", F.explode(F.sequence(F.lit(0).cast("bigint"), portions - 1)))
        .repartition(*names, "__portion")
        .withColumn("__member", F.explode(F.sequence(F.lit(1).cast("bigint"), portion)))
        .select(*names)
    )


def drop_duplicates(df: DataFrame, by_fingerprint: bool = False) -> DataFrame:
    """One row of each group of equal rows; as all columns agree, any will do.

    Missing equals missing: NaN comes out as NULL.  ``by_fingerprint`` leaves rows whose
    fingerprint occurs once where they are.
    """
    marked = _marked(df) if by_fingerprint else None
    if marked is None:
        return normalise_missing(df).dropDuplicates()
    names = [ref(c) for c in df.columns]
    return marked.where("NOT __again").select(*names).unionByName(marked.where("__again").select(*names).dropDuplicates())
