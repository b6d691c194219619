"""Queries on missing values, duplicates and outliers."""

from pyspark.sql import functions as F

from tablewright.operators import cleaning as ops
from tablewright.operators import outliers
from tablewright.plans.registry import (
    DAYS_SQL,
    GAPS_SQL,
    line_numbers,
    order_days,
    orders_with_gaps,
    query,
    table,
)


@query(
    "c1_missing_summary",
    GAPS_SQL
    + """
    SELECT 'o_orderkey' AS "column", count(*) - count(o_orderkey) AS missing_count,
           round((count(*) - count(o_orderkey)) * 100.0 / count(*), 6) AS missing_pct FROM gaps
    UNION ALL SELECT 'price', count(*) - count(price), round((count(*) - count(price)) * 100.0 / count(*), 6) FROM gaps
    UNION ALL SELECT 'status', count(*) - count(status), round((count(*) - count(status)) * 100.0 / count(*), 6) FROM gaps
    UNION ALL SELECT 'customer', count(*) - count(customer), round((count(*) - count(customer)) * 100.0 / count(*), 6) FROM gaps
    """,
)
def missing_summary(spark, sf):
    found = ops.missing_summary(orders_with_gaps(spark, sf))
    return found.withColumn("missing_pct", F.round("missing_pct", 6))


def _filled(df):
    return df.withColumns({"price": F.round("price", 4), "customer": F.round("customer", 4)})


@query(
    "c2_fill_mean",
    GAPS_SQL
    + """
    SELECT o_orderkey, round(coalesce(price, (SELECT avg(price) FROM gaps)), 4) AS price, status,
           round(coalesce(CAST(customer AS DOUBLE), (SELECT avg(customer) FROM gaps)), 4) AS customer
    FROM gaps
    """,
)
def fill_mean(spark, sf):
    return _filled(ops.fill_missing(orders_with_gaps(spark, sf), "mean"))


@query(
    "c3_fill_median",
    GAPS_SQL
    + """
    SELECT o_orderkey, round(coalesce(price, (SELECT quantile_cont(price, 0.5) FROM gaps)), 4) AS price, status,
           round(coalesce(CAST(customer AS DOUBLE), (SELECT quantile_cont(CAST(customer AS DOUBLE), 0.5) FROM gaps)), 4) AS customer
    FROM gaps
    """,
)
def fill_median(spark, sf):
    return _filled(ops.fill_missing(orders_with_gaps(spark, sf), "median"))


def _mode(column):
    return f"""(SELECT {column} FROM gaps WHERE {column} IS NOT NULL
                GROUP BY {column} ORDER BY count(*) DESC, {column} LIMIT 1)"""


@query(
    "c4_fill_mode",
    GAPS_SQL
    + f"""
    SELECT o_orderkey, coalesce(price, {_mode("price")}) AS price, coalesce(status, {_mode("status")}) AS status,
           coalesce(customer, {_mode("customer")}) AS customer
    FROM gaps
    """,
)
def fill_mode(spark, sf):
    return ops.fill_missing(orders_with_gaps(spark, sf), "mode")


@query(
    "c5_fill_constant",
    GAPS_SQL
    + """
    SELECT o_orderkey, coalesce(price, 0.0) AS price, coalesce(status, '0') AS status,
           coalesce(customer, 0) AS customer
    FROM gaps
    """,
)
def fill_constant(spark, sf):
    return ops.fill_missing(orders_with_gaps(spark, sf), "constant", "0")


@query(
    "c6_drop_missing",
    GAPS_SQL
    + "SELECT * FROM gaps WHERE price IS NOT NULL AND status IS NOT NULL AND customer IS NOT NULL",
)
def drop_missing(spark, sf):
    return ops.fill_missing(orders_with_gaps(spark, sf), "drop")


@query(
    "c7_duplicates",
    DAYS_SQL
    + """
    SELECT o_orderstatus, o_orderpriority, order_day FROM (
      SELECT *, count(*) OVER (PARTITION BY o_orderstatus, o_orderpriority, order_day) AS copies FROM days)
    WHERE copies > 1
    """,
)
def duplicates(spark, sf):
    return ops.duplicate_rows(order_days(spark, sf))


@query(
    "c7_duplicate_count",
    DAYS_SQL
    + """
    SELECT CAST(coalesce(sum(copies), 0) AS BIGINT) AS duplicates FROM (
      SELECT count(*) AS copies FROM days
      GROUP BY o_orderstatus, o_orderpriority, order_day HAVING count(*) > 1)
    """,
)
def duplicate_count(spark, sf):
    return ops.duplicate_count(order_days(spark, sf))


@query("c8_drop_duplicates", DAYS_SQL + "SELECT DISTINCT * FROM days")
def drop_duplicates(spark, sf):
    return ops.drop_duplicates(order_days(spark, sf))


def line_copies(spark, sf):
    """All columns of the lines, those of every fortieth order twice."""
    lines = table(spark, sf, "lineitem").withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd"))
    return lines.unionByName(lines.where("l_orderkey % 40 = 0"))


COPIES_SQL = """
WITH one AS (SELECT * REPLACE (strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate) FROM lineitem),
     copied AS (SELECT * FROM one UNION ALL SELECT * FROM one WHERE l_orderkey % 40 = 0)
"""


@query(
    "c7_duplicates_wide",
    COPIES_SQL + "SELECT *, count(*) AS copies FROM copied GROUP BY ALL HAVING count(*) > 1",
)
def duplicates_wide(spark, sf):
    return ops.duplicate_groups(line_copies(spark, sf), by_fingerprint=True)


@query("c8_drop_duplicates_wide", COPIES_SQL + "SELECT DISTINCT * FROM copied")
def drop_duplicates_wide(spark, sf):
    return ops.drop_duplicates(line_copies(spark, sf), by_fingerprint=True)


def _outlier_sql(source, column):
    return f"""
    SELECT '{column}' AS "column", count(*) FILTER (WHERE {column} < lo OR {column} > hi) AS num_outliers,
           round(count(*) FILTER (WHERE {column} < lo OR {column} > hi) * 100.0 / count(*), 2) AS pct_outliers
    FROM {source}, (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (
      SELECT quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.75) AS q3 FROM {source}))
    """


@query(
    "c9_outliers",
    " UNION ALL ".join(
        _outlier_sql("lineitem", c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    ),
)
def outlier_summary(spark, sf):
    found = outliers.outlier_summary(line_numbers(spark, sf))
    return found.withColumn("pct_outliers", F.round("pct_outliers", 2))


@query("c9_outliers_skewed", _outlier_sql("events", "value"))
def outlier_summary_skewed(spark, sf):
    found = outliers.outlier_summary(table(spark, sf, "events"), ["value"])
    return found.withColumn("pct_outliers", F.round("pct_outliers", 2))


@query(
    "c10_remove_outliers",
    """
    WITH base AS (SELECT event_id, value, value * value AS squared FROM events),
    b1 AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM base),
    r1 AS (SELECT base.* FROM base, b1
           WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)),
    b2 AS (SELECT quantile_cont(squared, 0.25) AS q1, quantile_cont(squared, 0.75) AS q3 FROM r1)
    SELECT event_id, value FROM r1, b2
    WHERE squared BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)
    """,
)
def remove_outliers(spark, sf):
    base = table(spark, sf, "events").selectExpr("event_id", "value", "value * value AS squared")
    return outliers.remove_outliers(base, ["value", "squared"]).select("event_id", "value")


@query(
    "c10_remove_outliers_simultaneous",
    """
    WITH base AS (SELECT event_id, value, value * value AS squared FROM events),
    b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3,
                 quantile_cont(squared, 0.25) AS s1, quantile_cont(squared, 0.75) AS s3 FROM base)
    SELECT event_id, value FROM base, b
    WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)
      AND squared BETWEEN s1 - 1.5 * (s3 - s1) AND s3 + 1.5 * (s3 - s1)
    """,
)
def remove_outliers_simultaneous(spark, sf):
    base = table(spark, sf, "events").selectExpr("event_id", "value", "value * value AS squared")
    kept = outliers.remove_outliers(base, ["value", "squared"], simultaneous=True)
    return kept.select("event_id", "value")
