"""Row filters.  Each is a plain predicate, so Catalyst merges a chain into one
scan and pushes what Parquet understands.  Rows whose tested value is missing
never pass.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.columns import is_datetime, is_nested, present, ref, text_form
from tablewright.functions.reports import statistics
from tablewright.operators.columns import column_roles
from tablewright.operators.sqltext import sql_select

# Fixed value: a column offers a pick list when it has at most this many values.
PICK_LIST_VALUES = 50
_SPECIAL = re.compile(r"[\\.^$*+?{}\[\]|()#\s]")


@dataclass(frozen=True)
class NumericRange:
    """``low <= column <= high``, both ends included."""

    column: str
    low: float
    high: float

    def predicate(self, df: DataFrame) -> Column | None:
        return ref(self.column).between(self.low, self.high)

    def apply(self, df: DataFrame) -> DataFrame:
        return _where(df, self.predicate(df))


@dataclass(frozen=True)
class OneOf:
    """Value among ``values``; an empty list means no filter.

    A list of any length is one predicate, which Spark looks up in a hash set.
    """

    column: str
    values: list = field(default_factory=list)

    def predicate(self, df: DataFrame) -> Column | None:
        return ref(self.column).isin(list(self.values)) if self.values else None

    def apply(self, df: DataFrame) -> DataFrame:
        return _where(df, self.predicate(df))


@dataclass(frozen=True)
class DateRange:
    """From the start of ``start`` to the end of ``end``, the whole last day included."""

    column: str
    start: date
    end: date

    def predicate(self, df: DataFrame) -> Column | None:
        dtype = df.schema[self.column].dataType
        column = ref(self.column)
        if not is_datetime(dtype):
            column, dtype = F.try_to_timestamp(column.cast("string")), T.TimestampType()
        first = F.lit(self.start.isoformat()).cast("date").cast(dtype)
        after = F.lit((self.end + timedelta(days=1)).isoformat()).cast("date").cast(dtype)
        return (column >= first) & (column < after)

    def apply(self, df: DataFrame) -> DataFrame:
        return _where(df, self.predicate(df))


@dataclass(frozen=True)
class IsBool:
    """Equality with a boolean; None means no filter."""

    column: str
    value: bool | None

    def predicate(self, df: DataFrame) -> Column | None:
        return None if self.value is None else ref(self.column) == F.lit(self.value)

    def apply(self, df: DataFrame) -> DataFrame:
        return _where(df, self.predicate(df))


@dataclass(frozen=True)
class TextSearch:
    """The term occurs in the text form of any of the columns (all by default).

    The term is a regular expression unless ``literal``.  An empty term means no
    filter.  Missing cells never match.  A term without special characters is
    looked up as plain text, which is faster and means the same.
    """

    term: str
    columns: list[str] | None = None
    case: bool = False
    literal: bool = False

    def predicate(self, df: DataFrame) -> Column | None:
        if not self.term:
            return None
        names = df.columns if self.columns is None else self.columns
        cells = [text_form(df.schema[name]) for name in names]
        return reduce(Column.__or__, [self._hit(cell) for cell in cells]) if cells else F.lit(False)

    def _hit(self, cell: Column) -> Column:
        if self.literal or _SPECIAL.search(self.term) is None:
            if self.case:
                return cell.contains(self.term)
            return F.lower(cell).contains(F.lower(F.lit(self.term)))
        return cell.rlike(self.term if self.case else "(?iu)" + self.term)

    def apply(self, df: DataFrame) -> DataFrame:
        return _where(df, self.predicate(df))


Filter = NumericRange | OneOf | DateRange | IsBool | TextSearch
# A chain runs dates, then numbers, then categories, then booleans, then text.
_CHAIN_ORDER = (DateRange, NumericRange, OneOf, IsBool, TextSearch)


def _where(df: DataFrame, predicate: Column | None) -> DataFrame:
    return df if predicate is None else df.where(predicate)


def numeric_range(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return NumericRange(column, low, high).apply(df)


def one_of(df: DataFrame, column: str, values: list) -> DataFrame:
    return OneOf(column, values).apply(df)


def date_range(df: DataFrame, column: str, start: date, end: date) -> DataFrame:
    return DateRange(column, start, end).apply(df)


def is_bool(df: DataFrame, column: str, value: bool | None) -> DataFrame:
    return IsBool(column, value).apply(df)


def text_search(
    df: DataFrame, term: str, columns: list[str] | None = None, case: bool = False, literal: bool = False
) -> DataFrame:
    return TextSearch(term, columns, case, literal).apply(df)


def apply_filters(
    df: DataFrame, filters: list[Filter], sql: str | None = None, on_error: str = "raise", nan_as_null: bool = True
) -> DataFrame:
    """SQL text first, then the filters; each works on what the previous one kept.

    ``nan_as_null=False`` tells that the table holds no NaN: ranges of floating-point
    columns then reach Parquet through the SQL text, too.
    """
    kept = sql_select(df, sql, on_error, nan_as_null) if sql else df
    for kind in _CHAIN_ORDER:
        for one in filters:
            if isinstance(one, kind):
                kept = one.apply(kept)
    return kept


def filter_summary(df: DataFrame, filters: list[Filter], sql: str | None = None) -> DataFrame:
    """``(total, kept, kept_pct)`` of a chain: one pass, with a SQL text two counts.

    A SQL text may give more rows than the table has; the share then exceeds 100.
    """
    if sql and sql.strip():
        counted = df.agg(F.count("*").alias("total"), F.lit(0).cast("bigint").alias("kept")).unionByName(
            apply_filters(df, filters, sql).agg(F.lit(0).cast("bigint").alias("total"), F.count("*").alias("kept"))
        )
        total, kept = F.sum("total"), F.sum("kept")
    else:
        predicates = [p for p in (one.predicate(df) for one in filters) if p is not None]
        keep = reduce(Column.__and__, predicates) if predicates else F.lit(True)
        counted, total, kept = df, F.count("*"), F.count_if(keep)
    share = F.round(F.coalesce(F.try_divide(kept * 100.0, total), F.lit(0.0)), 1)
    return counted.agg(total.alias("total"), kept.alias("kept"), share.alias("kept_pct"))


def summary_message(total: int, kept: int) -> str:
    """The kept share as a sentence for people."""
    if kept == total:
        return f"Showing all {total:,} rows"
    share = kept / total * 100 if total else 0.0
    return f"Filtered: {kept:,} / {total:,} rows ({share:.1f}%)"


def filter_domains(df: DataFrame) -> DataFrame:
    """What a user can filter by, one row per column.

    ``(column, role, min_value, max_value, choices)``: bounds as text for numbers
    and dates, the sorted distinct values for categorical and boolean columns
    that have at most 50 of them.
    """
    roles = column_roles(df)
    aggregates = {}
    for name in roles["numeric"] + roles["datetime"]:
        value = present(df.schema[name])
        aggregates["min", name] = F.min(value).cast("string")
        aggregates["max", name] = F.max(value).cast("string")
    pickable = [
        c for c in roles["categorical"] + roles["boolean"] if not is_nested(df.schema[c].dataType)
    ]
    for name in pickable:
        aggregates["about", name] = F.approx_count_distinct(ref(name))
    found = statistics(df, aggregates) if aggregates else {}

    # The sketch only rules out columns far above the bound; the rest is counted exactly.
    few = [c for c in pickable if found["about", c] <= 2 * PICK_LIST_VALUES]
    choices = {}
    if few:
        sets = statistics(df, {c: F.sort_array(F.collect_set(ref(c).cast("string"))) for c in few})
        choices = {c: values for c, values in sets.items() if len(values) <= PICK_LIST_VALUES}
    rows = [
        (f.name, _role(roles, f.name), found.get(("min", f.name)), found.get(("max", f.name)), choices.get(f.name))
        for f in df.schema.fields
    ]
    return df.sparkSession.createDataFrame(
        rows, "column string, role string, min_value string, max_value string, choices array<string>"
    )


def _role(roles: dict[str, list[str]], name: str) -> str:
    return next(role for role, names in roles.items() if name in names)
