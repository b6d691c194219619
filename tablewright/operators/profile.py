"""Profiles of a table: numeric and categorical summaries, correlations,
missing-value patterns and key figures.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import VectorAssembler
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.columns import is_boolean, missing, number, numeric_names, present, ref
from tablewright.functions.quantiles import column_quantiles
from tablewright.functions.reports import row_report, statistics
from tablewright.functions.values import text_counts

HARDLY_VARIES = 1e-6  # share of the sum of squares that is left around the mean
WIDE_COLUMNS = 20

SUMMARY_SCHEMA = (
    "column string, count bigint, mean double, std double, min double, p25 double, p50 double, "
    "p75 double, max double, skew double, kurtosis double"
)


def numeric_summary(
    df: DataFrame, columns: list[str] | None = None, digits: int | None = 4, approx: bool = False
) -> DataFrame:
    """Count, mean, sample deviation, five-number summary, skewness and kurtosis.

    Skewness and excess kurtosis are the bias-adjusted sample forms: NULL below
    three and four values, 0 for a constant column.  ``approx`` takes the quartiles
    from a sketch.
    """
    names = numeric_names(df, columns)
    aggregates = {}
    for name in names:
        value = number(df, name)
        aggregates[name, "count"] = F.count(value)
        aggregates[name, "mean"] = F.avg(value)
        aggregates[name, "std"] = F.stddev_samp(value)
        aggregates[name, "min"] = F.min(value)
        aggregates[name, "max"] = F.max(value)
        aggregates[name, "skew"] = sample_skewness(value)
        aggregates[name, "kurtosis"] = sample_kurtosis(value)
    found = statistics(df, aggregates) if names else {}
    counts = {c: found[c, "count"] for c in names}
    quartiles = column_quantiles(df, names, [0.25, 0.5, 0.75], approx=approx, counts=counts)
    rows = []
    for name in names:
        p25, p50, p75 = quartiles[name] or [None] * 3
        one = {figure: value for (column, figure), value in found.items() if column == name}
        rows.append((name, one["count"], one["mean"], one["std"], one["min"], p25, p50, p75, one["max"], one["skew"], one["kurtosis"]))
    table = df.sparkSession.createDataFrame(rows, SUMMARY_SCHEMA)
    if digits is None:
        return table
    return table.withColumns({c: F.round(c, digits) for c in table.columns[2:]})


def sample_skewness(value: Column) -> Column:
    n = F.count(value).cast("double")
    adjusted = F.sqrt(n * (n - 1)) / (n - 2) * F.skewness(value)
    return F.when(n < 3, None).when(F.min(value) == F.max(value), F.lit(0.0)).otherwise(adjusted)


def sample_kurtosis(value: Column) -> Column:
    n = F.count(value).cast("double")
    adjusted = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(value) + 6)
    return F.when(n < 4, None).when(F.min(value) == F.max(value), F.lit(0.0)).otherwise(adjusted)


def categorical_names(df: DataFrame) -> list[str]:
    """Text and boolean columns: what a categorical summary covers."""
    return [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) or is_boolean(f.dataType)
    ]


def categorical_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column, unique_values, most_frequent, freq_count)`` per text or boolean column.

    Distinct values leave out the missing one; the most frequent value may be
    the missing one (NULL).  Ties go to the smallest value.
    """
    names = categorical_names(df) if columns is None else columns
    if not names:
        return df.sparkSession.createDataFrame(
            [], "column string, unique_values bigint, most_frequent string, freq_count bigint"
        )
    order = F.struct(-F.col("n"), F.col("value").isNull(), F.col("value"))
    return (
        text_counts(df, names)
        .groupBy("column")
        .agg(
            F.count("value").alias("unique_values"),
            F.min_by("value", order).alias("most_frequent"),
            F.max("n").alias("freq_count"),
        )
    )


def pearson(x: Column, y: Column) -> Column:
    """Pearson correlation over rows where both are present; NULL if one is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pairwise-complete Pearson correlations in long form ``(col_a, col_b, corr)``.

    The upper triangle is computed and mirrored.  The pairs of a narrow table are
    single aggregates.  In a wide one a first look finds means and deviations, and
    one more scan sums the products of all pairs, gaps or not.
    """
    names = numeric_names(df, columns)
    wide = _wide_pairs(df, names) if len(names) >= WIDE_COLUMNS else {}
    rows = []
    for i, a in enumerate(names):
        for b in names[i:]:
            if (a, b) in wide:
                continue
            if a == b:  # exactly 1, or NULL for a constant
                corr = F.try_divide(F.var_samp(number(df, a)), F.var_samp(number(df, a)))
            else:
                corr = pearson(number(df, a), number(df, b))
            rows.append({"col_a": F.lit(a), "col_b": F.lit(b), "corr": corr})
    schema = "col_a string, col_b string, corr double"
    upper = row_report(df, rows, schema)
    if wide:
        pairs = [(a, b, corr) for (a, b), corr in wide.items()]
        upper = upper.unionByName(df.sparkSession.createDataFrame(pairs, schema))
    mirrored = F.when(
        F.col("col_a") != F.col("col_b"),
        F.array(
            F.struct("col_a", "col_b", "corr"),
            F.struct(F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), "corr"),
        ),
    ).otherwise(F.array(F.struct("col_a", "col_b", "corr")))
    return upper.select(F.inline(mirrored))


def _wide_pairs(df: DataFrame, names: list[str]) -> dict[tuple[str, str], float | None]:
    """Correlations of the upper triangle, but for pairs that need a closer look.

    Left out are columns with infinite values, and pairs in whose common rows a
    column hardly varies: there, sums of products are not exact enough.
    """
    aggregates = {}
    for name in names:
        aggregates[name, "mean"] = F.avg(number(df, name))
        aggregates[name, "std"] = F.stddev_samp(number(df, name))
    found = statistics(df, aggregates)
    flat = [c for c in names if not found[c, "std"]]  # without spread: no correlation with anything
    known = [c for c in names if found[c, "std"] and math.isfinite(found[c, "std"])]
    pairs = {(a, b): None for i, a in enumerate(names) for b in names[i:] if a in flat or b in flat}
    if known:
        scaled = {c: (number(df, c) - F.lit(found[c, "mean"])) / F.lit(found[c, "std"]) for c in known}
        pairs |= _matrix_pairs(_with_presence(df, scaled), known)
    return pairs


def _with_presence(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """One vector per row: the values with gaps as 0, flags of presence, squares."""
    values = [F.coalesce(c, F.lit(0.0)) for c in columns.values()]
    flags = [c.isNotNull().cast("double") for c in columns.values()]
    parts = {f"c{i}": c for i, c in enumerate([*values, *flags, *[v * v for v in values]])}
    narrow = df.select(*[c.alias(name) for name, c in parts.items()])
    return VectorAssembler(inputCols=list(parts), outputCol="v").transform(narrow).select("v")


def _matrix_pairs(vectors: DataFrame, names: list[str]) -> dict[tuple[str, str], float | None]:
    """Correlations from the sums of products of all vector entries, merged in a tree."""
    products = RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "v")).computeGramianMatrix().toArray()
    k = len(names)
    value, flag, square = slice(0, k), slice(k, 2 * k), slice(2 * k, 3 * k)
    n, total, squares = products[flag, flag], products[value, flag], products[square, flag]
    pairs: dict[tuple[str, str], float | None] = {}
    for i, a in enumerate(names):
        for j in range(i, k):
            if n[i, j] < 2:
                pairs[a, names[j]] = None
                continue
            left = squares[i, j] - total[i, j] ** 2 / n[i, j]
            right = squares[j, i] - total[j, i] ** 2 / n[i, j]
            if left > HARDLY_VARIES * squares[i, j] and right > HARDLY_VARIES * squares[j, i]:
                both = products[i, j] - total[i, j] * total[j, i] / n[i, j]
                pairs[a, names[j]] = 1.0 if i == j else float(both / math.sqrt(left * right))
    return pairs


def pair_correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """The correlation of exactly two columns, as one number."""
    return df.agg(pearson(number(df, a), number(df, b)).alias("corr"))


def missing_mask(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """0/1 per cell; ``keys`` are carried along to name the rows."""
    keys = keys or []
    return df.select(
        *[ref(k) for k in keys],
        *[missing(f).cast("int").alias(f.name) for f in df.schema.fields if f.name not in keys],
    )


def missing_patterns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """How often each combination of missing cells occurs: the mask at any table size."""
    names = df.columns if columns is None else columns
    mask = df.select(*[missing(df.schema[c]).cast("int").alias(c) for c in names])
    return mask.groupBy(*[ref(c) for c in names]).agg(F.count("*").alias("row_count"))


def missing_rates(df: DataFrame, along: str, buckets: int = 30) -> DataFrame:
    """Share of missing cells per column in equal-width buckets of the numeric column ``along``.

    The picture of the mask for tables with more rows than a screen:
    ``(bucket, row_count, one column per other column)``.
    """
    value = number(df, along)
    found = statistics(df, {"low": F.min(value), "high": F.max(value)})
    low, width = found["low"] or 0.0, ((found["high"] or 0.0) - (found["low"] or 0.0)) / buckets
    place = F.least(F.floor((value - low) / F.lit(width)), F.lit(buckets - 1)) if width else F.when(value.isNotNull(), 0)
    rates = [F.avg(missing(f).cast("double")).alias(f.name) for f in df.schema.fields if f.name != along]
    return df.groupBy(place.cast("bigint").alias("bucket")).agg(F.count("*").alias("row_count"), *rates)


def key_figures(
    df: DataFrame,
    mean_of: str | None = None,
    median_of: str | None = None,
    sum_of: str | None = None,
    unique_of: str | None = None,
    approx: bool = False,
) -> DataFrame:
    """Row count, column count and missing cells, plus the asked figures, as one row.

    ``approx`` takes median and distinct count from sketches.
    """
    cells = F.lit(0).cast("bigint")
    for f in df.schema.fields:
        cells = cells + F.count_if(missing(f))
    figures = {
        "row_count": F.count("*"),
        "column_count": F.lit(len(df.columns)).cast("bigint"),
        "missing_values": cells,
    }
    if mean_of:
        figures["mean"] = F.avg(number(df, mean_of))
    if median_of:
        middle = column_quantiles(df, [median_of], [0.5], approx=approx)[median_of]
        figures["median"] = F.lit(middle[0] if middle else None).cast("double")
    if sum_of:
        figures["sum"] = F.coalesce(F.sum(number(df, sum_of)), F.lit(0.0))
    if unique_of:
        counter = F.approx_count_distinct if approx else F.count_distinct
        figures["unique"] = counter(present(df.schema[unique_of]))
    return df.agg(*[v.alias(k) for k, v in figures.items()])
