"""Column roles, references and the single notion of a missing value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGER_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOAT_TYPES = (T.FloatType, T.DoubleType)
DATETIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def ref(name: str) -> Column:
    """Column by its exact name, also when it holds dots, spaces or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, FLOAT_TYPES)


def is_integer(dtype: T.DataType) -> bool:
    return isinstance(dtype, INTEGER_TYPES)


def is_numeric(dtype: T.DataType) -> bool:
    return is_float(dtype) or is_integer(dtype) or isinstance(dtype, T.DecimalType)


def is_datetime(dtype: T.DataType) -> bool:
    return isinstance(dtype, DATETIME_TYPES)


def is_boolean(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.BooleanType)


def is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ArrayType, T.MapType, T.StructType))


def present(field: T.StructField) -> Column:
    """The column with NaN turned into NULL; other types pass unchanged."""
    column = ref(field.name)
    if is_float(field.dataType):
        return F.nanvl(column, F.lit(None).cast(field.dataType))
    return column


def missing(field: T.StructField) -> Column:
    """True where the value is NULL or, for floating point, NaN."""
    column = ref(field.name)
    if is_float(field.dataType):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def number(df: DataFrame, name: str) -> Column:
    """A numeric column as double, NaN as NULL."""
    return present(df.schema[name]).cast("double")


def numeric_names(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    """Numeric columns in schema order, or the numeric ones among ``columns``."""
    numeric = [f.name for f in df.schema.fields if is_numeric(f.dataType)]
    if columns is None:
        return numeric
    return [name for name in columns if name in numeric]


def check_names(kept: list[str], added: list[str]) -> None:
    """Raise if a result with these kept and added columns held a name twice."""
    twice = sorted({name for name in added if name in kept})
    if twice:
        raise ValueError(f"the result has columns {twice} of its own: rename those of the table first")


def normalise_missing(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL once, e.g. right after reading a source."""
    floats = {f.name: present(f) for f in df.schema.fields if is_float(f.dataType)}
    return df.withColumns(floats) if floats else df


def text_form(field: T.StructField) -> Column:
    """A value as text, missing values NULL: booleans as True and False, numbers plainly.

    Spark writes doubles from 1e7 up, and below 1e-3, with an exponent; between 1e-4
    and 1e16 they are written out here.
    """
    value = present(field)
    text = value.cast("string")
    if isinstance(field.dataType, T.BooleanType):
        return F.initcap(text)
    if not isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return text
    digits = F.regexp_replace(text.try_cast("decimal(38,21)").cast("string"), r"0+$", "")
    plain = F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)
    size = F.abs(value)
    return F.when(text.contains("E") & (size >= 1e-4) & (size < 1e16), plain).otherwise(text)
