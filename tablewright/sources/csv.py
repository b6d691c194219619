"""CSV files, folders and globs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.columns import normalise_missing, ref
from tablewright.functions.reports import statistics

# Cell texts that mean a missing value.
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# Quotes inside a quoted cell are doubled, for reading and for writing.
FORMAT = {"header": True, "escape": '"'}

NUMBER = r"^(?i)[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)$"
# Texts of booleans.
BOOLEAN_TEXTS = ("True", "TRUE", "true", "False", "FALSE", "false")


def read_csv(
    spark: SparkSession,
    path: str | list[str] | None,
    schema: T.StructType | str | None = None,
    parse_dates: bool = False,
    mode: str = "strict",
    mixed_headers: bool = False,
    **options: object,
) -> DataFrame:
    """CSV with a header.  No path gives an empty table.

    Columns go by name.  A file whose header differs from the others' fails, unless
    ``mixed_headers``: then a pass over the files finds their headers first, and a
    column that a file lacks is NULL there.

    Pass ``multiLine=True`` for cells with line breaks: a file is then read by one
    task.  With a ``schema`` the files are read once, when the result is used; a cell
    that does not fit its type raises, with ``mode="lenient"`` it becomes NULL.
    Without one a first pass over all rows finds the types: whole numbers, numbers,
    booleans, with ``parse_dates`` timestamps, else text.
    """
    if mode not in ("strict", "lenient"):
        raise ValueError(f"unknown cast mode: {mode!r}")
    if path is None:
        return spark.createDataFrame([], T.StructType([]))
    reader = spark.read.options(**{**FORMAT, "enforceSchema": False, **options})
    if mixed_headers:
        layouts = [reader.csv(files) for files in files_by_header(spark, path)]
        raw = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), layouts)
    else:
        raw = reader.csv(path)
    text = raw.select(*[missing_cell(ref(c)).alias(c) for c in raw.columns])
    if schema is None:
        return infer_types(text, parse_dates)
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    absent = [name for name in wanted.fieldNames() if name not in raw.columns]
    if absent:
        raise ValueError(f"columns {absent} are not in the header")
    return normalise_missing(text.select(*[_as_type(f, mode).alias(f.name) for f in wanted.fields]))


def files_by_header(spark: SparkSession, path: str | list[str]) -> list[list[str]]:
    """The files under ``path``, one list per distinct header line."""
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    # The first block of a file is read in order by one task.
    headers = lines.where("file_block_start = 0").groupBy("file_path").agg(F.first("value").alias("header"))
    found = headers.groupBy("header").agg(F.sort_array(F.collect_list("file_path")).alias("files")).collect()
    return sorted(r["files"] for r in found)


def _as_type(field: T.StructField, mode: str) -> Column:
    if isinstance(field.dataType, T.StringType):
        return ref(field.name)
    cell = F.trim(ref(field.name))
    return cell.cast(field.dataType) if mode == "strict" else cell.try_cast(field.dataType)


def missing_cell(column: Column) -> Column:
    return F.when(~column.isin(*MISSING_TEXTS), column)


def _boolean(column: Column) -> Column:
    return F.when(column.isin(*BOOLEAN_TEXTS), F.lower(column)).try_cast("boolean")


def infer_types(df: DataFrame, parse_dates: bool = False) -> DataFrame:
    """Cast text columns to the narrowest type that holds all their values: one pass."""
    ladder = {
        "bigint": lambda c: c.try_cast("bigint"),
        "double": lambda c: c.try_cast("double"),
        "boolean": _boolean,
    }
    if parse_dates:
        ladder["timestamp_ntz"] = lambda c: c.try_cast("timestamp_ntz")
    aggregates = {}
    for name in df.columns:
        aggregates[name, "all"] = F.count(ref(name))
        for kind, convert in ladder.items():
            trial = convert(F.trim(ref(name)))
            if kind == "bigint":  # 1.0 and 1e3 are numbers, but not written as whole ones
                trial = F.when(F.trim(ref(name)).rlike(r"^[+-]?\d+$"), trial)
            if kind == "double":  # a cast would take 10D and 20F for numbers, too
                trial = F.when(F.trim(ref(name)).rlike(NUMBER), trial)
            aggregates[name, kind] = F.count(trial)
    found = statistics(df, aggregates) if df.columns else {}
    casts = []
    for name in df.columns:
        total = found[name, "all"]
        fitting = [k for k in ladder if found[name, k] == total] if total else ["double"]
        casts.append(ladder[fitting[0]](F.trim(ref(name))).alias(name) if fitting else ref(name))
    return df.select(*casts)


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV parts, each with a header."""
    df.write.mode("overwrite").options(**FORMAT).csv(path)


def load_table(spark: SparkSession, path: str | None, kind: str, **options: object) -> DataFrame:
    """Read by declared file type: ``csv``, or ``xlsx``/``excel`` for workbooks."""
    if path is None:
        return spark.createDataFrame([], T.StructType([]))
    kind = kind.lower()
    if kind == "csv":
        return read_csv(spark, path, **options)
    if kind in ("xlsx", "excel"):
        from tablewright.sources.workbook import read_workbooks

        return read_workbooks(spark, path, **options)
    raise ValueError(f"unsupported file type: {kind!r}")
