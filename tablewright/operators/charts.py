"""The data behind each chart.  Drawing is left to the caller.

Aggregated charts return a handful of rows at any table size.  Point charts
return the points themselves, as the chart shows them all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.columns import check_names, missing, number, numeric_names, ref
from tablewright.functions.lookup import lookup_join
from tablewright.functions.quantiles import column_quantiles, quantile_table
from tablewright.functions.reports import statistics
from tablewright.operators.outliers import FENCE, fences

# Fixed value: number of bins per axis.
BINS = 30
DENSITY_BINS = 512
DENSITY_POINTS = 100


def _listed(*names: str | None) -> list[str]:
    """The given column names without gaps and repetitions."""
    return list(dict.fromkeys(n for n in names if n))


def _bounds(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float] | None]:
    aggregates = {}
    for name in columns:
        aggregates["low", name] = F.min(number(df, name))
        aggregates["high", name] = F.max(number(df, name))
    found = statistics(df, aggregates)
    return {
        c: None if found["low", c] is None else (found["low", c], found["high", c]) for c in columns
    }


def _bin(value: Column, low: float, high: float, bins: int) -> Column:
    """Index of the equal-width bin; the maximum belongs to the last one."""
    width = (high - low) / bins
    if width == 0:
        return F.when(value.isNotNull(), F.lit(0)).cast("bigint")
    return F.least(F.floor((value - low) / F.lit(width)), F.lit(bins - 1)).cast("bigint")


def histogram(df: DataFrame, column: str, color: str | None = None, bins: int = BINS) -> DataFrame:
    """``([color], bin, bin_start, bin_end, count)`` over equal-width bins."""
    check_names(_listed(color), ["bin", "bin_start", "bin_end", "count"])
    groups = [ref(color)] if color else []
    limits = _bounds(df, [column])[column]
    low, high = limits or (0.0, 0.0)
    width = (high - low) / bins
    value = number(df, column)
    counted = (
        df.where(value.isNotNull())
        .groupBy(*groups, _bin(value, low, high, bins).alias("bin"))
        .agg(F.count("*").alias("count"))
    )
    return counted.select(
        *groups,
        "bin",
        (F.lit(low) + F.col("bin") * F.lit(width)).alias("bin_start"),
        (F.lit(low) + (F.col("bin") + 1) * F.lit(width)).alias("bin_end"),
        "count",
    )


def rug(df: DataFrame, column: str, color: str | None = None) -> DataFrame:
    """The single values drawn along the axis of a histogram."""
    return df.select(*[ref(c) for c in _listed(color, column)]).where(number(df, column).isNotNull())


def _quartiles(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """``(*by, n, q1, median, q3, low_fence, high_fence)`` per group."""
    q = F.col("quantiles")
    reach = FENCE * (q[2] - q[0])
    return (
        quantile_table(df, [column], [0.25, 0.5, 0.75], by)
        .where("n > 0")
        .select(
            *[ref(k) for k in by],
            "n",
            q[0].alias("q1"),
            q[1].alias("median"),
            q[2].alias("q3"),
            (q[0] - reach).alias("low_fence"),
            (q[2] + reach).alias("high_fence"),
        )
    )


_QUARTILE_TYPES = {
    "n": "bigint", "q1": "double", "median": "double", "q3": "double", "low_fence": "double", "high_fence": "double",
}


def _with_quartiles(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """``(*by, __value)`` rows next to the quartiles of their group."""
    values = df.select(*[ref(k) for k in by], number(df, column).alias("__value"))
    values = values.where(F.col("__value").isNotNull())
    if by:
        return lookup_join(values, _quartiles(df, column, by), by)
    middle = column_quantiles(df, [column], [0.25, 0.5, 0.75])[column]
    if middle is None:
        return values.limit(0).withColumns({n: F.lit(None).cast(t) for n, t in _QUARTILE_TYPES.items()})
    q1, median, q3 = middle
    low, high = fences(q1, q3)
    n = values.count()
    return values.withColumns(
        {name: F.lit(v).cast(t) for (name, t), v in zip(_QUARTILE_TYPES.items(), (n, q1, median, q3, low, high))}
    )


def box_stats(df: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """Five-number box with whiskers at the last value inside the fences.

    ``([by], n, min, q1, median, q3, max, lower_whisker, upper_whisker, outliers)``;
    rows without a group are left out.
    """
    keys = [by] if by else []
    check_names(keys, ["min", "max", "lower_whisker", "upper_whisker", "outliers", *_QUARTILE_TYPES])
    inside = F.col("__value").between(F.col("low_fence"), F.col("high_fence"))
    columns = ["n", "q1", "median", "q3"]
    grouped = (
        _with_quartiles(df, column, keys)
        .groupBy(*[ref(k) for k in keys], *columns)
        .agg(
            F.min("__value").alias("min"),
            F.max("__value").alias("max"),
            F.min(F.when(inside, F.col("__value"))).alias("lower_whisker"),
            F.max(F.when(inside, F.col("__value"))).alias("upper_whisker"),
            F.count_if(~inside).alias("outliers"),
        )
    )
    return grouped.select(
        *[ref(k) for k in keys],
        *["n", "min", "q1", "median", "q3", "max", "lower_whisker", "upper_whisker", "outliers"],
    )


def box_points(df: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """Points drawn next to the boxes: all without groups, else the outliers."""
    if by is None:
        return df.select(number(df, column).alias("value")).where(F.col("value").isNotNull())
    return box_outliers(df, column, by)


def box_outliers(df: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """``([by], value)`` of the rows outside the fences of their group."""
    keys = [by] if by else []
    check_names(keys, ["value", *_QUARTILE_TYPES])
    outside = ~F.col("__value").between(F.col("low_fence"), F.col("high_fence"))
    rows = _with_quartiles(df, column, keys).where(outside)
    return rows.select(*[ref(k) for k in keys], F.col("__value").alias("value"))


def scatter_points(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """Points with both coordinates."""
    return df.select(*[ref(c) for c in _listed(x, y, color)]).where(
        number(df, x).isNotNull() & number(df, y).isNotNull()
    )


def ols_trend(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """Least-squares line of y on x per colour: ``([color], n, slope, intercept, r2)``.

    A group with one x only has no slope: all three are NULL.
    """
    check_names(_listed(color), ["n", "slope", "intercept", "r2"])
    groups = [ref(color)] if color else []
    a, b = number(df, x), number(df, y)
    both = a.isNotNull() & b.isNotNull()
    points = df.where(both).select(*groups, a.alias("__x"), b.alias("__y"))
    xx = F.var_pop("__x")
    slope = F.try_divide(F.covar_pop("__x", "__y"), xx)
    r2 = F.try_divide(F.pow(F.covar_pop("__x", "__y"), 2), xx * F.var_pop("__y"))
    return points.groupBy(*groups).agg(
        F.count("*").alias("n"),
        slope.alias("slope"),
        (F.avg("__y") - slope * F.avg("__x")).alias("intercept"),
        F.when((xx > 0) & (F.var_pop("__y") == 0), F.lit(1.0)).otherwise(r2).alias("r2"),
    )


def pair_points(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows of a scatter matrix: the chosen, or all, numeric columns."""
    names = numeric_names(df) if columns is None else columns
    return df.select(*[ref(c) for c in names])


def pie(df: DataFrame, column: str) -> DataFrame:
    """``(column, count, share)`` of the values that are not missing."""
    check_names([column], ["count", "share"])
    counted = (
        df.where(~missing(df.schema[column])).groupBy(ref(column)).agg(F.count("*").alias("count"))
    )
    total = counted.agg(F.sum("count")).scalar()
    return counted.withColumn("share", F.try_divide(F.col("count").cast("double"), total))


def bar(df: DataFrame, x: str, y: str, aggregation: str = "sum", color: str | None = None) -> DataFrame:
    """Sum, mean or count of y per x [and colour]; rows without x are left out.

    The sum of a group without values is 0, its mean NULL; count counts values.
    Any other aggregation name means sum.
    """
    value = number(df, y)
    if aggregation == "mean":
        height = F.avg(value)
    elif aggregation == "count":
        height = F.count(value)
    else:
        height = F.coalesce(F.sum(value), F.lit(0.0))
    check_names(_listed(x, color), ["height"])
    groups = [ref(c) for c in _listed(x, color)]
    return df.where(~missing(df.schema[x])).groupBy(*groups).agg(height.alias("height"))


def line(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """Points of a line chart, ordered by colour and x, ties by y."""
    names = _listed(color, x, y)
    return df.select(*[ref(c) for c in names]).orderBy(*[ref(c) for c in names])


def line_buckets(
    df: DataFrame, x: str, y: str, unit: str = "day", aggregation: str = "mean", color: str | None = None
) -> DataFrame:
    """A line of one point per time unit, for more points than a chart can show."""
    bucket = F.date_trunc(unit, ref(x)).cast(df.schema[x].dataType)
    return bar(df.withColumn(x, bucket), x, y, aggregation, color)


def area(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """Stacked area: ``(x, [color], height, stack_low, stack_high)``.

    Heights are summed before they are stacked, so a stack is as long as the
    number of colours.
    """
    names = _listed(x, color)
    check_names(names, ["height", "stack_low", "stack_high"])
    groups = [ref(c) for c in names]
    summed = df.groupBy(*groups).agg(F.coalesce(F.sum(number(df, y)), F.lit(0.0)).alias("height"))
    if color is None:
        return summed.select(*groups, "height", F.lit(0.0).alias("stack_low"), F.col("height").alias("stack_high"))
    stack = (
        Window.partitionBy(ref(x)).orderBy(ref(color)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return summed.withColumn("stack_high", F.sum("height").over(stack)).select(
        *groups, "height", (F.col("stack_high") - F.col("height")).alias("stack_low"), "stack_high"
    )


def violin_stats(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """Box, mean, deviation and kernel width of y per x [and colour].

    Width by the rule of thumb 1.059 min(std, IQR / 1.349) n^(-1/5), at least one
    hundredth of the range.
    """
    keys = _listed(x, color)
    check_names(keys, ["min", "max", "mean", "std", "bandwidth", *_QUARTILE_TYPES])
    key_columns, value = [ref(k) for k in keys], number(df, y)
    shape = (
        df.where(value.isNotNull())
        .groupBy(*key_columns)
        .agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    )
    grouped = _quartiles(df, y, keys).join(shape, keys)  # one row per group on either side
    spread = F.least(F.coalesce("std", F.lit(0.0)), (F.col("q3") - F.col("q1")) / 1.349)
    rule = 1.059 * spread * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    width = F.greatest(rule, (F.col("max") - F.col("min")) / 100)
    return grouped.select(
        *[ref(k) for k in keys], "n", "min", "q1", "median", "q3", "max", "mean", "std", width.alias("bandwidth")
    )


def violin_density(
    df: DataFrame, x: str, y: str, color: str | None = None, bins: int = DENSITY_BINS, points: int = DENSITY_POINTS
) -> DataFrame:
    """Gaussian density of y per group on an even grid: ``(x, [color], point, position, density)``.

    Values are counted into fine bins first; the kernels are summed over a
    group's bins, at most ``bins`` of them, inside one row.  The grid reaches two
    widths beyond the data.  A group of equal values gets density NULL.
    """
    keys = _listed(x, color)
    check_names(keys, ["point", "position", "density", "in_bin", "bin", "bins", "center"])
    key_columns = [ref(k) for k in keys]
    stats = violin_stats(df, x, y, color).select(*key_columns, "n", "min", "max", "bandwidth")
    values = df.select(*key_columns, number(df, y).alias("__value")).where(F.col("__value").isNotNull())
    span = (F.col("max") - F.col("min")) / bins
    index = F.least(F.coalesce(F.floor(F.try_divide(F.col("__value") - F.col("min"), span)), F.lit(0)), F.lit(bins - 1))
    shape = ["n", "min", "max", "bandwidth"]
    binned = (
        lookup_join(values, stats, keys)
        .groupBy(*key_columns, *shape, index.cast("bigint").alias("bin"))
        .agg(F.count("*").alias("in_bin"))
        .withColumn("center", F.col("min") + (F.col("bin") + 0.5) * span)
        .groupBy(*key_columns, *shape)
        .agg(F.sort_array(F.collect_list(F.struct("center", "in_bin"))).alias("bins"))
    )
    width = F.col("bandwidth")
    start = F.col("min") - 2 * width
    step = (F.col("max") - F.col("min") + 4 * width) / (points - 1)
    norm = 1 / math.sqrt(2 * math.pi)
    on_grid = binned.select(
        *key_columns, *shape, "bins", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: start + i * step)).alias("point", "position")
    )
    kernel = F.aggregate(
        "bins",
        F.lit(0.0),
        lambda total, b: total
        + b["in_bin"] * F.exp(-0.5 * F.pow(F.try_divide(F.col("position") - b["center"], width), F.lit(2.0))),
    )
    return on_grid.select(
        *key_columns, "point", "position", F.try_divide(kernel * norm, F.col("n") * width).alias("density")
    )


def density_heatmap(df: DataFrame, x: str, y: str, bins: int = BINS) -> DataFrame:
    """``(x_bin, y_bin, x_start, y_start, count)`` over an equal-width grid."""
    limits = _bounds(df, [x, y])
    (x_low, x_high), (y_low, y_high) = limits[x] or (0.0, 0.0), limits[y] or (0.0, 0.0)
    a, b = number(df, x), number(df, y)
    counted = (
        df.where(a.isNotNull() & b.isNotNull())
        .groupBy(_bin(a, x_low, x_high, bins).alias("x_bin"), _bin(b, y_low, y_high, bins).alias("y_bin"))
        .agg(F.count("*").alias("count"))
    )
    return counted.select(
        "x_bin",
        "y_bin",
        (F.lit(x_low) + F.col("x_bin") * F.lit((x_high - x_low) / bins)).alias("x_start"),
        (F.lit(y_low) + F.col("y_bin") * F.lit((y_high - y_low) / bins)).alias("y_start"),
        "count",
    )


def radar(
    df: DataFrame,
    value_columns: list[str],
    category: str | None = None,
    aggregation: str = "mean",
    order_by: list[str] | None = None,
) -> DataFrame:
    """``(name, axis, value)``: mean or sum per category, in one pass.

    Without a category the axes show the first row under ``order_by``, which is
    then required.
    """
    if category is None:
        if not order_by:
            raise ValueError("a radar chart without category needs order_by to name its first row")
        source = df.orderBy(*[ref(c) for c in order_by]).limit(1)
        source = source.select(F.lit("Values").alias("name"), *[number(df, c).alias(c) for c in value_columns])
    else:
        total = aggregation == "sum"
        source = (
            df.where(~missing(df.schema[category]))
            .groupBy(ref(category).cast("string").alias("name"))
            .agg(
                *[
                    (F.coalesce(F.sum(number(df, c)), F.lit(0.0)) if total else F.avg(number(df, c))).alias(c)
                    for c in value_columns
                ]
            )
        )
    axes = F.array(*[F.struct(F.lit(c).alias("axis"), ref(c).alias("value")) for c in value_columns])
    return source.select("name", F.inline(axes))
