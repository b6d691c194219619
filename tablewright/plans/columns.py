"""Queries on column operators."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import missing
from tablewright.functions.reports import row_report
from tablewright.operators import columns as ops
from tablewright.plans.registry import flagged_lines, orders_with_gaps, query, table


def _present_counts(df):
    """Role and number of filled cells per column."""
    rows = [{"column": F.lit(f.name), "present": F.count_if(~missing(f))} for f in df.schema.fields]
    counts = row_report(df, rows, "column string, present bigint")
    return ops.column_role_table(df).join(counts, "column")


def _roles_sql(source, roles):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{role}' AS role, count({c}) AS present FROM {source}"""
        for c, role in roles.items()
    )


@query(
    "t1_column_roles",
    "WITH lines AS (SELECT l_linestatus, l_quantity, l_returnflag = 'R' AS returned FROM lineitem) "
    + _roles_sql(
        "events",
        {"event_id": "numeric", "ts": "datetime", "user_id": "numeric", "event_type": "categorical", "value": "numeric", "props": "categorical"},
    )
    + " UNION ALL "
    + _roles_sql("lines", {"l_linestatus": "categorical", "l_quantity": "numeric", "returned": "boolean"}),
)
def column_roles(spark, sf):
    lines = flagged_lines(spark, sf).select("l_linestatus", "l_quantity", "returned")
    return _present_counts(table(spark, sf, "events")).unionByName(_present_counts(lines))


@query(
    "t2_rename",
    "SELECT o_orderkey AS order_id, o_totalprice AS price, o_orderstatus FROM orders",
)
def rename(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return ops.rename_columns(orders, {"o_orderkey": "order_id", "o_totalprice": "price", "absent": "x"})


@query(
    "t3_cast",
    """
    SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey,
           CAST(trunc(o_totalprice) AS BIGINT) AS o_totalprice,
           epoch_us(o_orderdate) * 1000 AS o_orderdate,
           o_orderstatus <> '' AS o_orderstatus,
           o_custkey <> 0 AS o_custkey
    FROM orders
    """,
)
def cast(spark, sf):
    targets = {
        "o_orderkey": "object",
        "o_totalprice": "int64",
        "o_orderdate": "int",
        "o_orderstatus": "bool",
        "o_custkey": "bool",
    }
    return ops.change_types(table(spark, sf, "orders"), targets).select(*targets)


@query(
    "t3_cast_lenient",
    """
    SELECT o_orderkey, TRY_CAST(o_orderpriority AS DOUBLE) AS o_orderpriority,
           CAST(o_totalprice AS DOUBLE) AS o_totalprice
    FROM orders
    """,
)
def cast_lenient(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return ops.change_types(orders, {"o_orderpriority": "float", "o_totalprice": "float64"}, mode="lenient")


@query("t4_drop_columns", "SELECT p_partkey, p_name, p_size FROM part")
def drop_columns(spark, sf):
    return ops.drop_columns(table(spark, sf, "part"), ["p_brand", "p_type", "p_retailprice"])


@query(
    "t5_time_columns",
    """
    SELECT 'o_orderdate' AS "column", strftime(min(o_orderdate), '%Y-%m-%d') AS first_day,
           strftime(max(o_orderdate), '%Y-%m-%d') AS last_day FROM orders
    UNION ALL SELECT 'l_shipdate', strftime(min(l_shipdate), '%Y-%m-%d'), strftime(max(l_shipdate), '%Y-%m-%d') FROM lineitem
    UNION ALL SELECT 'ts', strftime(min(ts), '%Y-%m-%d'), strftime(max(ts), '%Y-%m-%d') FROM events
    """,
)
def time_columns(spark, sf):
    parts = []
    for name in ("orders", "lineitem", "events", "customer", "part"):
        df = table(spark, sf, name)
        rows = [
            {
                "column": F.lit(c),
                "first_day": F.date_format(F.min(c), "yyyy-MM-dd"),
                "last_day": F.date_format(F.max(c), "yyyy-MM-dd"),
            }
            for c in ops.time_columns(df)
        ]
        parts.append(row_report(df, rows, "column string, first_day string, last_day string"))
    return reduce(DataFrame.unionByName, parts)


@query(
    "s6_preview",
    """
    SELECT o_orderkey, price, status FROM (
      SELECT o_orderkey,
             CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price,
             CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS status
      FROM orders) ORDER BY o_orderkey LIMIT 100
    """,
)
def preview(spark, sf):
    return ops.preview(orders_with_gaps(spark, sf).drop("customer"), ["o_orderkey"])
