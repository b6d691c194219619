"""First sheets of .xlsx workbooks: one task per workbook.

A sheet holds at most 1,048,576 rows by format, so a workbook fits a task; a
folder of them is read in parallel.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.columns import normalise_missing, ref
from tablewright.sources.csv import infer_types, missing_cell

# Workbooks are parsed on the executors, which need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Names inside the file format, and its day zero.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_SHEET_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_DAY_ZERO = "1899-12-30"


def read_workbooks(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, mode: str = "strict"
) -> DataFrame:
    """Rows of the first sheet of every workbook under ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    return parse_workbooks(files, schema, mode)


def parse_workbooks(files: DataFrame, schema: T.StructType | str | None = None, mode: str = "strict") -> DataFrame:
    """Parse a ``(path, content)`` table of workbooks.  Columns are found by header name.

    A cell that does not fit the declared type raises, with ``mode="lenient"`` it
    becomes NULL.  Without a schema the headers give the columns and a pass over all
    cells their types; dates, which the format stores as numbers, come out as numbers.
    """
    if mode not in ("strict", "lenient"):
        raise ValueError(f"unknown cast mode: {mode!r}")
    if schema is None:
        text = _cells(files, header_names(files))
        return infer_types(text.select(*[missing_cell(ref(c)).alias(c) for c in text.columns]))
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    text = _cells(files, wanted.fieldNames())
    return normalise_missing(text.select(*[_typed(f, mode).alias(f.name) for f in wanted.fields]))


def header_names(files: DataFrame) -> list[str]:
    """Header names of all workbooks, by their first place; a sheet has at most 16,384 columns."""

    def headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                first = next(sheet_rows(content), {})
                yield pd.DataFrame([(t, p) for p, t in first.items() if t is not None], columns=["name", "place"])

    found = files.select("content").mapInPandas(headers, "name string, place bigint")
    return [r["name"] for r in found.groupBy("name").agg(F.min("place").alias("place")).orderBy("place", "name").collect()]


def _cells(files: DataFrame, names: list[str]) -> DataFrame:
    """The named columns of all first sheets as text."""
    as_text = T.StructType([T.StructField(n, T.StringType()) for n in names])

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                header: dict[str, int] | None = None
                rows: list[list[str | None]] = []
                for cells in sheet_rows(content):
                    if header is None:
                        header = {text: place for place, text in cells.items()}
                        continue
                    rows.append([cells.get(header.get(n, -1)) for n in names])
                    if len(rows) == 50_000:
                        yield pd.DataFrame(rows, columns=names, dtype=object)
                        rows = []
                yield pd.DataFrame(rows, columns=names, dtype=object)

    return files.select("content").mapInPandas(parse, as_text)


def _typed(field: T.StructField, mode: str):
    """The cell as the declared type; whole numbers may be written as 8.0, dates as days."""
    column = ref(field.name)
    if not isinstance(field.dataType, T.StringType):
        column = missing_cell(column)
    fitting = _fitting(field, column)
    if mode == "lenient" or isinstance(field.dataType, T.StringType):
        return fitting
    return F.when(column.isNotNull() & fitting.isNull(), column.cast(field.dataType)).otherwise(fitting)


def _fitting(field: T.StructField, column: Column):
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        micros = F.round(column.try_cast("double") * 86_400_000_000).cast("bigint")
        serial = F.timestamp_add("MICROSECOND", micros, F.lit(_DAY_ZERO).cast("timestamp_ntz"))
        return F.coalesce(serial.cast(field.dataType), column.try_cast(field.dataType))
    if isinstance(field.dataType, T.StringType):
        return column
    if isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.coalesce(column.try_cast(field.dataType), column.try_cast("double").try_cast(field.dataType))
    return column.try_cast(field.dataType)


def sheet_rows(content: bytes) -> Iterator[dict[int, str | None]]:
    """Rows of the first sheet as ``{column place: text}``, streamed."""
    import io
    import posixpath
    import re
    import zipfile
    from xml.etree import ElementTree

    def text_of(node) -> str:
        # Phonetic hints (rPh) are not part of the value.
        own = node.findall(f"{_MAIN}t") + node.findall(f"{_MAIN}r/{_MAIN}t")
        return "".join(t.text or "" for t in own)

    with zipfile.ZipFile(io.BytesIO(content)) as book:
        link = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{_MAIN}sheets/{_MAIN}sheet").get(_SHEET_LINK)
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        sheet = posixpath.normpath(posixpath.join("/xl", targets[link])).lstrip("/")
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = [text_of(s) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall(f"{_MAIN}si")]
        for _, row in ElementTree.iterparse(book.open(sheet)):
            if row.tag != f"{_MAIN}row":
                continue
            cells: dict[int, str | None] = {}
            for order, cell in enumerate(row.findall(f"{_MAIN}c")):
                place = order
                letters = re.match("[A-Z]+", cell.get("r") or "")
                if letters:
                    place = 0
                    for letter in letters.group():
                        place = place * 26 + ord(letter) - 64
                    place -= 1
                value, kind = cell.find(f"{_MAIN}v"), cell.get("t")
                if kind == "inlineStr":
                    cells[place] = text_of(cell.find(f"{_MAIN}is"))
                elif value is None or value.text is None or kind == "e":
                    cells[place] = None
                elif kind == "s":
                    cells[place] = shared[int(value.text)]
                elif kind == "b":
                    cells[place] = "true" if value.text == "1" else "false"
                else:
                    cells[place] = value.text
            row.clear()
            if any(v is not None for v in cells.values()):
                yield cells
