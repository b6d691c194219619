"""Column operators: roles, rename, change type, drop, preview."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.columns import is_boolean, is_datetime, is_numeric, ref

ROLES = ("numeric", "categorical", "datetime", "boolean")

# Names of target types a user can ask for, and their Spark types.
TARGET_TYPES = {
    "float": "double",
    "float64": "double",
    "int": "bigint",
    "int64": "bigint",
    "object": "string",
    "category": "string",
    "bool": "boolean",
}


def role_of(dtype: T.DataType) -> str:
    """datetime, boolean and numeric are tried in this order; the rest is categorical."""
    if is_datetime(dtype):
        return "datetime"
    if is_boolean(dtype):
        return "boolean"
    return "numeric" if is_numeric(dtype) else "categorical"


def column_roles(df: DataFrame) -> dict[str, list[str]]:
    """Column names per role, in schema order."""
    return {role: [f.name for f in df.schema.fields if role_of(f.dataType) == role] for role in ROLES}


def column_role_table(df: DataFrame) -> DataFrame:
    """The roles as ``(column, role)``."""
    rows = [(f.name, role_of(f.dataType)) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "column string, role string")


def time_columns(df: DataFrame) -> list[str]:
    """Columns that can be the time axis of a series."""
    return column_roles(df)["datetime"]


def rename_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename by an old-to-new map; unknown old names are ignored."""
    if any(not new for new in names.values()):
        raise ValueError("a new column name must not be empty")
    return df.withColumnsRenamed(names)


def change_types(df: DataFrame, targets: dict[str, str], mode: str = "strict") -> DataFrame:
    """Change column types.

    ``strict`` raises on a value that does not convert, ``lenient`` gives NULL.
    NULL stays NULL for every target.
    """
    if mode not in ("strict", "lenient"):
        raise ValueError(f"unknown cast mode: {mode!r}")
    changed = {}
    for name, target in targets.items():
        if target not in TARGET_TYPES:
            raise ValueError(f"unsupported target type: {target!r}")
        changed[name] = _converted(df.schema[name], TARGET_TYPES[target], mode)
    return df.withColumns(changed) if changed else df


def _converted(field: T.StructField, target: str, mode: str) -> Column:
    column, source = ref(field.name), field.dataType
    if is_datetime(source) and target in ("bigint", "double"):
        return epoch_nanos(field).cast(target)
    if target == "boolean":
        if is_datetime(source):
            raise ValueError(f"datetime column {field.name!r} has no boolean form")
        if isinstance(source, T.StringType):
            return column != ""
        if is_numeric(source):
            return column != 0
    return column.cast(target) if mode == "strict" else column.try_cast(target)


def epoch_nanos(field: T.StructField) -> Column:
    """Nanoseconds since 1970-01-01 of a date or timestamp."""
    return F.expr(epoch_nanos_sql(field))


def epoch_nanos_sql(field: T.StructField) -> str:
    """The same as SQL text.  A wall-clock value counts as UTC whatever the session zone is."""
    name = "`" + field.name.replace("`", "``") + "`"
    if isinstance(field.dataType, T.TimestampType):
        return f"unix_micros({name}) * 1000L"
    days = f"unix_date(CAST({name} AS DATE)) * 86400000000000L"
    if isinstance(field.dataType, T.DateType):
        return days
    second = f"CAST(extract(SECOND FROM {name}) * 1000000 AS BIGINT) * 1000L"
    return f"({days} + hour({name}) * 3600000000000L + minute({name}) * 60000000000L + {second})"


def drop_columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.drop(*names)


def preview(df: DataFrame, order_by: list[str], rows: int = 100) -> DataFrame:
    """The first rows under an explicit order, as a top-k without a full sort."""
    return df.orderBy(*[ref(c) for c in order_by]).limit(rows)
