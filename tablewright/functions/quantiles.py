"""Exact quantiles with linear interpolation, for tables of any size.

Spark's ``percentile`` keeps the distinct values of a group in one task.  That
is fine for a counted, small table.  Beyond it:

* whole columns narrow a value range around each wanted rank.  A sample proposes
  the range, one scan counts exactly what lies below, in and on its ends, and
  only when few values are left do they meet in one task.  The driver holds two
  numbers per rank, nothing is shuffled, and the sample never decides a result.
* groups count their values in cells first.  The counts tell which cell holds a
  rank.  A cell with few values is sorted in one task; one with many is cut again
  around its ranks, by values that a sketch of its rows proposes, as often as it
  takes.  Only rows of cells that hold a rank are looked at again.

Either way equal values are counted, not moved, so a value that fills a third of
the table costs no more than any other.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.columns import missing, number, ref
from tablewright.functions.lookup import lookup_join, settled
from tablewright.functions.reports import statistics

IN_TASK_ROWS = 100_000
SAMPLE_ROWS = 50_000
SAMPLE_SEED = 42
SKETCH_ACCURACY = 10_000
FIRST_CELLS = 256  # in which all groups are counted at once
GRID = 256  # steps of the sketch that cuts one cell again


def column_quantiles(
    df: DataFrame,
    columns: list[str],
    probabilities: list[float],
    in_task_rows: int | None = None,
    approx: bool = False,
    counts: dict[str, int] | None = None,
) -> dict[str, list[float] | None]:
    """Quantiles of whole columns on the driver: one short list per column, None without values.

    ``approx`` answers from a sketch in one scan, without interpolation.  ``counts``
    spares a scan when the number of values per column is known.
    """
    if not columns:
        return {}
    limit = IN_TASK_ROWS if in_task_rows is None else in_task_rows
    if approx:
        return statistics(df, {c: F.percentile_approx(number(df, c), probabilities, SKETCH_ACCURACY) for c in columns})
    if counts is None:
        counts = statistics(df, {c: F.count(number(df, c)) for c in columns})
    if max(counts.values()) <= limit:
        return statistics(df, {c: F.percentile(number(df, c), probabilities) for c in columns})
    # NaN stays in: as the largest value it fails every upper bound, and bare
    # comparisons are what Parquet can test.
    narrow = df.select(*[ref(c).cast("double").alias(c) for c in columns])
    positions = {c: [p * (counts[c] - 1) for p in probabilities] for c in columns if counts[c]}
    wanted = {(c, end(x)) for c, places in positions.items() for x in places for end in (math.floor, math.ceil)}
    values = _order_statistics(narrow, wanted, counts, max(limit, 1))
    found: dict[str, list[float] | None] = {c: None for c in columns}
    for c, places in positions.items():
        found[c] = [_between(values[c, math.floor(x)], values[c, math.ceil(x)], x - math.floor(x)) for x in places]
    return found


def _between(low: float, high: float, share: float) -> float:
    return low if share == 0 else (1 - share) * low + share * high


@dataclass(frozen=True)
class _Range:
    """Values of a column strictly between two known ones; None is no bound."""

    column: str
    low: float | None
    high: float | None
    below: int  # values up to and including ``low``
    inside: int

    def holds(self) -> Column:
        value = ref(self.column)
        return self.bounds() & value.isNotNull() & ~F.isnan(value)

    def bounds(self) -> Column:
        value, keep = ref(self.column), F.lit(True)
        if self.low is not None:
            keep = keep & (value > self.low)
        if self.high is not None:
            keep = keep & (value < self.high)
        return keep


def _order_statistics(
    narrow: DataFrame, wanted: set[tuple[str, int]], counts: dict[str, int], limit: int
) -> dict[tuple[str, int], float]:
    """The values at 0-based ranks of sorted columns."""
    found: dict[tuple[str, int], float] = {}
    ranges = {(c, rank): _Range(c, None, None, 0, counts[c]) for c, rank in wanted}
    sampled = True
    while ranges:
        few = {t: r for t, r in ranges.items() if r.inside <= limit}
        if few:
            # Ranks of one range share the sorted list; it has at most ``limit`` values.
            found |= statistics(
                _rows_in(narrow, few.values()),
                {
                    (c, rank): F.sort_array(F.collect_list(F.when(r.holds(), ref(c))))[rank - r.below]
                    for (c, rank), r in few.items()
                },
            )
            ranges = {t: r for t, r in ranges.items() if t not in few}
            continue
        pivots = _pivots(narrow, ranges, sampled)
        sampled = all(p is not None for p in pivots.values())
        pivots = {t: p for t, p in pivots.items() if p is not None}
        for target, outcome in _count_around(narrow, ranges, pivots).items():
            if isinstance(outcome, _Range):
                ranges[target] = outcome
            else:
                found[target] = outcome
                del ranges[target]
    return found


def _rows_in(narrow: DataFrame, ranges) -> DataFrame:
    """Rows that may lie in one of the ranges, by a condition Parquet can test."""
    distinct = set(ranges)
    if any(r.low is None and r.high is None for r in distinct):
        return narrow
    return narrow.where(reduce(Column.__or__, [r.bounds() for r in distinct]))


def _pivots(
    narrow: DataFrame, ranges: dict[tuple[str, int], _Range], sampled: bool
) -> dict[tuple[str, int], tuple[float, float] | None]:
    """Two values around each wanted rank, proposed by a sample of its range."""
    margin = 2 / math.sqrt(SAMPLE_ROWS)  # four standard errors of a sample median
    shares: dict[_Range, list[float]] = {}
    ends = {}
    for target, r in ranges.items():
        # Neighbouring ranks round to the same share, hence get the same pivots.
        share = round((target[1] - r.below + 0.5) / r.inside, 6)
        ends[target] = max(share - margin, 0.0), min(share + margin, 1.0)
        listed = shares.setdefault(r, [])
        listed += [e for e in ends[target] if e not in listed]
    rows, proposals = _rows_in(narrow, shares), {}
    chance = {r: SAMPLE_ROWS / r.inside if sampled else 1.0 for r in shares}
    lucky = rows.withColumn("__u", F.rand(SAMPLE_SEED)).where(F.col("__u") < max(chance.values()))
    for r, listed in shares.items():
        keep = r.holds() & (F.col("__u") < chance[r])
        proposals[r] = F.percentile_approx(F.when(keep, ref(r.column)), listed)
    found = statistics(lucky, proposals)
    pivots: dict[tuple[str, int], tuple[float, float] | None] = {}
    for target, r in ranges.items():
        at = dict(zip(shares[r], found[r] or []))
        pivots[target] = tuple(at[e] for e in ends[target]) if at else None
    return pivots


def _count_around(
    narrow: DataFrame,
    ranges: dict[tuple[str, int], _Range],
    pivots: dict[tuple[str, int], tuple[float, float]],
) -> dict[tuple[str, int], _Range | float]:
    """Where each rank falls: on a pivot, which then is the value, or in a smaller range."""
    if not pivots:
        return {}
    parts = {}
    for target, (low, high) in pivots.items():
        r = ranges[target]
        value = ref(r.column)
        parts[r, low, high, 0] = F.count_if(r.holds() & (value < low))
        parts[r, low, high, 1] = F.count_if(value == low)
        parts[r, low, high, 2] = F.count_if((value > low) & (value < high))  # never NaN
        parts[r, low, high, 3] = F.count_if(value == high) if high > low else F.lit(0)
    counted = statistics(_rows_in(narrow, [ranges[t] for t in pivots]), parts)
    outcome: dict[tuple[str, int], _Range | float] = {}
    for target, (low, high) in pivots.items():
        r = ranges[target]
        sizes = [counted[r, low, high, i] for i in range(4)]
        sizes.append(r.inside - sum(sizes))
        places = [(r.low, low), low, (low, high), high, (high, r.high)]
        below = r.below
        for size, place in zip(sizes, places):
            if target[1] < below + size:
                outcome[target] = _Range(r.column, *place, below, size) if isinstance(place, tuple) else place
                break
            below += size
    return outcome


def quantile_table(
    df: DataFrame,
    columns: list[str],
    probabilities: list[float],
    by: list[str],
    in_task_rows: int | None = None,
) -> DataFrame:
    """Quantiles per group: ``(*by, column, n, quantiles)``, one row per group and column.

    ``n`` counts the values that are not missing; rows whose group key is
    missing are left out.  A group without any value has n = 0 and NULL quantiles.
    """
    limit = IN_TASK_ROWS if in_task_rows is None else in_task_rows
    narrow = df.select(*[ref(k) for k in by], *[number(df, c).alias(c) for c in columns if c not in by])
    for key in by:
        narrow = narrow.where(~missing(df.schema[key]))
    total = narrow.count()
    if total <= limit:
        return _in_task(narrow, columns, probabilities, by)
    found = _by_cells(narrow, columns, probabilities, by, total, max(limit, 1))
    names = F.explode(F.array(*[F.lit(c) for c in columns])).alias("column")
    groups = narrow.select(*[ref(k) for k in by]).distinct().select(*[ref(k) for k in by], names)
    joined = groups.join(found, [*by, "column"], "left")
    return joined.withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).select(found.columns)


def _in_task(narrow: DataFrame, columns: list[str], probabilities: list[float], by: list[str]) -> DataFrame:
    packed = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.count(ref(c)).alias("n"),
                F.percentile(ref(c), probabilities).alias("quantiles"),
            )
            for c in columns
        ]
    )
    return (
        narrow.groupBy(*[ref(k) for k in by])
        .agg(packed.alias("__stats"))
        .select(*[ref(k) for k in by], F.inline("__stats"))
    )


def _by_cells(
    narrow: DataFrame, columns: list[str], probabilities: list[float], by: list[str], total: int, limit: int
) -> DataFrame:
    keys = [*by, "column"]
    rows = _with_cells(narrow, columns, by, total, limit)
    targets = settled(_first_targets(rows, keys, probabilities))
    found = []
    while True:
        one_value = F.col("__low") == F.col("__high")
        few = F.col("__in_cell") <= limit
        ranked = [ref(k) for k in keys] + [F.col("__n"), F.explode("__ranks").alias("__rank")]
        found.append(targets.where(one_value).select(*ranked, F.col("__low").alias("value")))
        found.append(_sorted_cells(rows, targets.where(~one_value & few), keys))
        open_cells = targets.where(~one_value & ~few)
        if open_cells.isEmpty():
            break
        rows = _cut_again(rows, open_cells, keys)
        targets = settled(_next_targets(rows, keys))
    at = F.map_from_entries(F.collect_list(F.struct("__rank", "value")))
    grouped = reduce(DataFrame.unionByName, found).groupBy(*[ref(k) for k in keys], "__n").agg(at.alias("__at"))
    quantiles = F.array(*[_interpolated(F.col("__at"), F.col("__n"), p) for p in probabilities])
    return grouped.select(*[ref(k) for k in keys], F.col("__n").alias("n"), quantiles.alias("quantiles"))


_CELL = ["__parent", "__digit"]


def _cell_counts(rows: DataFrame, keys: list[str], carried: list[str]) -> DataFrame:
    """Size and ends of each cell; two numbers tell whether it holds one value only."""
    ends = [F.count("*").alias("__in_cell"), F.min("value").alias("__low"), F.max("value").alias("__high")]
    return rows.groupBy(*[ref(k) for k in keys], *_CELL, *carried).agg(*ends)


def _placed(counts: DataFrame, keys: list[str], start: Column) -> DataFrame:
    """Cells that hold a wanted rank, with the number of smaller values in their group."""
    earlier = Window.partitionBy(*[ref(k) for k in keys], "__parent").orderBy("__digit")
    running = F.sum("__in_cell").over(earlier.rowsBetween(Window.unboundedPreceding, -1))
    return (
        counts.withColumn("__before", start + F.coalesce(running, F.lit(0)))
        .withColumn("__ranks", _ranks_in(F.col("__before"), F.col("__before") + F.col("__in_cell")))
        .where(F.size("__ranks") > 0)
        .select(*[ref(k) for k in keys], *_CELL, "__before", "__in_cell", "__low", "__high", "__n", "__ranks")
    )


def _first_targets(rows: DataFrame, keys: list[str], probabilities: list[float]) -> DataFrame:
    whole = Window.partitionBy(*[ref(k) for k in keys])
    counts = _cell_counts(rows, keys, []).withColumn("__n", F.sum("__in_cell").over(whole))
    return _placed(counts.withColumn("__ranks", _needed_ranks(F.col("__n"), probabilities)), keys, F.lit(0).cast("long"))


def _next_targets(rows: DataFrame, keys: list[str]) -> DataFrame:
    return _placed(_cell_counts(rows, keys, ["__start", "__n", "__ranks"]), keys, F.col("__start"))


def _cut_again(rows: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the cells, in smaller ones around the wanted ranks.

    A value from the sketch is a cell of its own, so every cut makes all other cells smaller
    than the one before, whatever the values look like.
    """
    names = [*keys, *_CELL]
    grid = [i / GRID for i in range(GRID + 1)]
    of_cells = lookup_join(rows.select(*[ref(k) for k in names], "value"), cells.select(*[ref(k) for k in names]), names)
    sketches = of_cells.groupBy(*[ref(k) for k in names]).agg(F.percentile_approx("value", grid, 16 * GRID).alias("__grid"))
    step = lambda r: F.floor((r - F.col("__before") + 0.5) / F.col("__in_cell") * GRID).cast("int")
    around = F.flatten(F.transform("__ranks", lambda r: F.slice("__grid", F.greatest(step(r), F.lit(1)), 4)))
    cuts = lookup_join(cells, sketches, names).select(
        *[ref(k) for k in names], F.col("__before").alias("__start"), "__n", "__ranks", F.array_distinct(around).alias("__cuts")
    )
    below = F.size(F.filter("__cuts", lambda c: c < F.col("value")))
    digit = 2 * below + F.array_contains("__cuts", F.col("value")).cast("int")
    return lookup_join(rows.select(*[ref(k) for k in names], "value"), settled(cuts), names).select(
        *[ref(k) for k in keys],
        F.concat_ws(".", "__parent", F.col("__digit").cast("string")).alias("__parent"),
        digit.alias("__digit"),
        "__start",
        "__n",
        "__ranks",
        "value",
    )


def _sorted_cells(rows: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """The values at the ranks of cells that one task can sort."""
    names = [*keys, *_CELL]
    cell = [ref(k) for k in names]
    in_order = Window.partitionBy(*cell).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    values = (
        lookup_join(rows.select(*cell, "value"), cells.select(*cell, "__before", "__n", "__ranks"), names)
        .groupBy(*cell, "__before", "__n", "__ranks", "value")
        .agg(F.count("*").alias("__copies"))
        .withColumn("__upto", F.col("__before") + F.sum("__copies").over(in_order))
        .withColumn("__ranks", _ranks_in(F.col("__upto") - F.col("__copies"), F.col("__upto")))
        .where(F.size("__ranks") > 0)
    )
    return values.select(*[ref(k) for k in keys], "__n", F.explode("__ranks").alias("__rank"), "value")


def _with_cells(narrow: DataFrame, columns: list[str], by: list[str], total: int, limit: int) -> DataFrame:
    """Long form ``(*by, column, __parent, __digit, value)``; cells cut each column into pieces of like size.

    The cuts come from a sample.  They only set how evenly the work is spread.
    """
    cells = min(FIRST_CELLS, max(64, total // limit))
    grid = [i / cells for i in range(cells + 1)]
    sample = narrow.sample(min(1.0, SAMPLE_ROWS / total), SAMPLE_SEED)
    proposed = statistics(sample, {c: F.percentile_approx(ref(c), grid, 2 * cells) for c in columns})
    inf = float("inf")
    cuts = [sorted({v for v in (proposed[c] or []) if abs(v) != inf}) or [0.0] for c in columns]
    bucketizer = Bucketizer(
        inputCols=columns,
        outputCols=[f"__cell{i}" for i in range(len(columns))],
        splitsArray=[[-inf, *c, inf] for c in cuts],
        handleInvalid="keep",
    )
    cell = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"), F.col(f"__cell{i}").cast("int").alias("__digit"), ref(c).alias("value")
            )
            for i, c in enumerate(columns)
        ]
    )
    bucketed = bucketizer.transform(narrow).select(*[ref(k) for k in by], F.lit("").alias("__parent"), F.inline(cell))
    return bucketed.where(F.col("value").isNotNull())


def _ranks_in(start: Column, end: Column) -> Column:
    return F.filter("__ranks", lambda r: (r >= start) & (r < end))


def _position(n: Column, p: float) -> Column:
    return (n - 1) * F.lit(float(p))


def _needed_ranks(n: Column, probabilities: list[float]) -> Column:
    ends = []
    for p in probabilities:
        ends += [F.floor(_position(n, p)).cast("long"), F.ceil(_position(n, p)).cast("long")]
    return F.array_distinct(F.array(*ends))


def _interpolated(at: Column, n: Column, p: float) -> Column:
    position = _position(n, p)
    low, high = F.floor(position).cast("long"), F.ceil(position).cast("long")
    share = position - low
    return F.when(low == high, at[low]).otherwise((1 - share) * at[low] + share * at[high])
