"""Queries on sources and sinks, fed with the tables themselves."""

import pandas as pd
from pyspark.sql import functions as F

from tablewright.operators import charts
from tablewright.plans.registry import orders_with_gaps, query, table
from tablewright.session import scratch_path
from tablewright.sources import csv, store, workbook

_CUSTOMERS_SQL = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"


@query(
    "s1_csv_roundtrip",
    """
    SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price,
           CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS status,
           CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_custkey AS BIGINT) END AS customer
    FROM orders
    """,
)
def csv_roundtrip(spark, sf):
    path = scratch_path(spark, "csv")
    csv.write_csv(orders_with_gaps(spark, sf), path)
    return csv.read_csv(spark, path)


@query(
    "s1_csv_declared_schema",
    "SELECT o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS order_day FROM orders",
)
def csv_declared_schema(spark, sf):
    path = scratch_path(spark, "csv")
    csv.write_csv(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate"), path)
    back = csv.read_csv(spark, path, schema="o_orderkey bigint, o_orderstatus string, o_orderdate timestamp_ntz")
    return back.select("o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_day"))


@query("s1_csv_mixed_headers", "SELECT o_orderkey, o_orderstatus, CAST(o_custkey AS BIGINT) AS o_custkey FROM orders")
def csv_mixed_headers(spark, sf):
    """Orders written in two column orders, read by one schema."""
    path = scratch_path(spark, "csv")
    orders = table(spark, sf, "orders")
    even, odd = orders.where("o_orderkey % 2 = 0"), orders.where("o_orderkey % 2 = 1")
    csv.write_csv(even.select("o_orderkey", "o_orderstatus", "o_custkey"), f"{path}/even")
    csv.write_csv(odd.select("o_custkey", "o_orderkey", "o_orderstatus"), f"{path}/odd")
    schema = "o_orderkey bigint, o_orderstatus string, o_custkey bigint"
    return csv.read_csv(spark, [f"{path}/even", f"{path}/odd"], schema, mixed_headers=True)


@query(
    "s2_xlsx_inferred",
    "SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer",
)
def xlsx_inferred(spark, sf):
    """Types found from the cells, without a declared schema."""
    return workbook.parse_workbooks(_as_workbooks(table(spark, sf, "customer"), "c_custkey"))


@query("s2_xlsx_folder", _CUSTOMERS_SQL)
def xlsx_folder(spark, sf):
    customers = table(spark, sf, "customer")
    return workbook.parse_workbooks(_as_workbooks(customers, "c_custkey"), customers.schema)


def _as_workbooks(df, key, rows_per_book=5000):
    """A ``(path, content)`` table of workbooks holding the rows of ``df``."""
    names = df.columns

    def pack(book):
        import io
        import zipfile
        from xml.sax.saxutils import escape

        main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
        office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        package = "http://schemas.openxmlformats.org/package/2006/relationships"

        def cell(value):
            if value is None or value != value:
                return "<c/>"
            if isinstance(value, str):
                return f'<c t="inlineStr"><is><t>{escape(value)}</t></is></c>'
            return f"<c><v>{value}</v></c>"

        lines = [names, *book[names].itertuples(index=False, name=None)]
        sheet = "".join(f"<row>{''.join(cell(v) for v in line)}</row>" for line in lines)
        content = io.BytesIO()
        with zipfile.ZipFile(content, "w", zipfile.ZIP_DEFLATED) as target:
            target.writestr(
                "xl/workbook.xml",
                f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="a" sheetId="1" r:id="r1"/></sheets></workbook>',
            )
            target.writestr(
                "xl/_rels/workbook.xml.rels",
                f'<Relationships xmlns="{package}"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
            )
            target.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{sheet}</sheetData></worksheet>')
        return pd.DataFrame({"path": ["book.xlsx"], "content": [content.getvalue()]})

    book = F.floor(F.col(key) / rows_per_book)
    return df.groupBy(book.alias("book")).applyInPandas(pack, "path string, content binary")


@query("s4_save_load", _CUSTOMERS_SQL)
def save_load(spark, sf):
    root = scratch_path(spark, "store")
    customers = table(spark, sf, "customer")
    store.save_table(customers.limit(0), root, "customers")
    store.save_table(customers, root, "customers")
    return store.load_table(spark, root, "customers")


@query(
    "v12_saved_chart",
    """SELECT l_returnflag, sum(l_quantity) AS height FROM lineitem GROUP BY l_returnflag""",
)
def saved_chart(spark, sf):
    root = scratch_path(spark, "store")
    store.save_chart(charts.bar(table(spark, sf, "lineitem"), "l_returnflag", "l_quantity"), root, "quantity")
    return store.load_chart(spark, root, "quantity")
