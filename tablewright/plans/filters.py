"""Queries on filters and on SQL texts over the current table."""

from datetime import date

from tablewright.operators import charts
from tablewright.operators import filters as ops
from tablewright.operators.sqltext import sql_select
from tablewright.plans.registry import flagged_lines, query, table


@query(
    "f1_numeric_range",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000",
)
def numeric_range(spark, sf):
    kept = ops.numeric_range(table(spark, sf, "orders"), "o_totalprice", 100000.0, 200000.0)
    return kept.select("o_orderkey", "o_totalprice")


@query(
    "f2_categorical_in",
    "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')",
)
def categorical_in(spark, sf):
    kept = ops.one_of(table(spark, sf, "customer"), "c_mktsegment", ["BUILDING", "MACHINERY"])
    return kept.select("c_custkey", "c_name", "c_mktsegment")


@query(
    "f3_date_range",
    """
    SELECT event_id, event_type, value FROM events
    WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-13'
    """,
)
def date_range(spark, sf):
    kept = ops.date_range(table(spark, sf, "events"), "ts", date(2024, 1, 5), date(2024, 1, 12))
    return kept.select("event_id", "event_type", "value")


@query(
    "f3_date_range_text",
    """
    SELECT order_day, count(*) AS n FROM (
      SELECT strftime(o_orderdate, '%Y-%m-%d') AS order_day FROM orders)
    WHERE order_day BETWEEN '1996-02-01' AND '1996-03-31' GROUP BY order_day
    """,
)
def date_range_text(spark, sf):
    days = table(spark, sf, "orders").selectExpr("date_format(o_orderdate, 'yyyy-MM-dd') AS order_day")
    kept = ops.date_range(days, "order_day", date(1996, 2, 1), date(1996, 3, 31))
    return kept.groupBy("order_day").count().withColumnRenamed("count", "n")


@query(
    "f4_boolean",
    """
    SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag = 'R' AS returned
    FROM lineitem WHERE l_returnflag = 'R'
    """,
)
def boolean(spark, sf):
    return ops.is_bool(flagged_lines(spark, sf), "returned", True).drop("l_linestatus")


@query(
    "f5_search_ci",
    """
    SELECT p_partkey, p_name, p_type FROM part
    WHERE regexp_matches(CAST(p_partkey AS VARCHAR), 'blue|promo', 'i')
       OR regexp_matches(p_name, 'blue|promo', 'i') OR regexp_matches(p_brand, 'blue|promo', 'i')
       OR regexp_matches(p_type, 'blue|promo', 'i')
       OR regexp_matches(CAST(p_size AS VARCHAR), 'blue|promo', 'i')
       OR regexp_matches(CAST(p_retailprice AS VARCHAR), 'blue|promo', 'i')
    """,
)
def search_ci(spark, sf):
    return ops.text_search(table(spark, sf, "part"), "BLUE|promo").select("p_partkey", "p_name", "p_type")


@query(
    "f5_search_literal",
    "SELECT doc_id, source FROM documents WHERE contains(lower(text), 'the')",
)
def search_literal(spark, sf):
    kept = ops.text_search(table(spark, sf, "documents"), "THE", ["text"], literal=True)
    return kept.select("doc_id", "source")


@query(
    "f6_search_cs",
    "SELECT p_partkey, p_brand FROM part WHERE regexp_matches(p_brand, 'Brand#1') OR regexp_matches(p_name, 'Brand#1')",
)
def search_cs(spark, sf):
    kept = ops.text_search(table(spark, sf, "part"), "Brand#1", ["p_brand", "p_name"], case=True)
    return kept.select("p_partkey", "p_brand")


def _sql_query(name, source, text, oracle=None):
    """A text over one table; by default the same text is its own check."""

    @query(name, oracle or text.replace(" df", f" {source}"))
    def run(spark, sf):
        return sql_select(table(spark, sf, source), text)

    return run


_sql_query("f7_sql_where", "part", "SELECT p_partkey, p_name, p_size FROM df WHERE p_size > 30")
_sql_query(
    "f7_sql_group",
    "orders",
    """SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 2) AS mean_price FROM df
       WHERE o_orderstatus <> 'P' GROUP BY o_orderpriority HAVING count(*) > 10""",
)
_sql_query(
    "f7_sql_selfjoin",
    "customer",
    """SELECT a.c_custkey, b.c_custkey AS other, a.c_nationkey FROM df a
       JOIN df b ON a.c_custkey + 1 = b.c_custkey AND a.c_nationkey = b.c_nationkey""",
)
_sql_query(
    "f7_sql_window",
    "orders",
    """SELECT o_custkey, o_orderkey, place FROM (
         SELECT o_custkey, o_orderkey,
                CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS place
         FROM df) ranked WHERE place <= 3""",
)
_sql_query(
    "f7_sql_setop",
    "orders",
    """SELECT o_custkey FROM df WHERE o_orderstatus = 'F'
       INTERSECT SELECT o_custkey FROM df WHERE o_orderstatus = 'O'
       EXCEPT SELECT o_custkey FROM df WHERE o_totalprice > 490000""",
)
_sql_query(
    "f7_sql_subquery",
    "orders",
    """SELECT o_orderkey, o_totalprice FROM df
       WHERE o_totalprice > (SELECT avg(o_totalprice) FROM df)
         AND o_custkey IN (SELECT o_custkey FROM df WHERE o_orderpriority = '1-URGENT')""",
)
_sql_query(
    "f7_sql_topk",
    "lineitem",
    """SELECT l_orderkey, l_linenumber, l_extendedprice FROM df
       ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 25""",
)
_sql_query(
    "f7_sql_scalar",
    "customer",
    """SELECT c_custkey, upper(substr(c_name, 1, 4)) AS short_name, length(c_name) AS name_length,
              abs(c_acctbal) AS size, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'credit' END AS side,
              coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment
       FROM df WHERE c_name LIKE 'Customer%'""",
    """SELECT c_custkey, upper(substr(c_name, 1, 4)) AS short_name, CAST(length(c_name) AS INTEGER) AS name_length,
              abs(c_acctbal) AS size, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'credit' END AS side,
              coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment
       FROM customer WHERE c_name LIKE 'Customer%'""",
)

_sql_query(
    "f7_sql_with_nested",
    "orders",
    """WITH big AS (SELECT * FROM df WHERE o_totalprice > 200000),
          orders_of AS (
            WITH big AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey)
            SELECT * FROM big WHERE n > 3)
       SELECT b.o_orderkey, b.o_custkey, o.n, (SELECT max(n) FROM orders_of) AS most
       FROM big b JOIN orders_of o ON b.o_custkey = o.o_custkey
       WHERE b.o_orderpriority IN (WITH df AS (SELECT '1-URGENT' AS p) SELECT p FROM df)""",
)

CHAIN = [
    ops.DateRange("o_orderdate", date(1996, 1, 1), date(1998, 12, 31)),
    ops.NumericRange("o_totalprice", 50000.0, 400000.0),
    ops.OneOf("o_orderstatus", ["F", "O"]),
]
CHAIN_WHERE = """o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'
      AND o_totalprice BETWEEN 50000 AND 400000 AND o_orderstatus IN ('F', 'O')"""


@query(
    "f8_filter_chain",
    f"SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_custkey % 2 = 0 AND {CHAIN_WHERE}",
)
def filter_chain(spark, sf):
    orders = table(spark, sf, "orders")  # prices are never NaN
    kept = ops.apply_filters(orders, CHAIN, sql="SELECT * FROM df WHERE o_custkey % 2 = 0", nan_as_null=False)
    return kept.select("o_orderkey", "o_orderstatus", "o_totalprice")


@query(
    "f8_filter_chain_bar",
    f"""
    SELECT o_orderpriority, round(sum(o_totalprice), 2) AS revenue
    FROM orders WHERE {CHAIN_WHERE} GROUP BY o_orderpriority
    """,
)
def filter_chain_bar(spark, sf):
    kept = ops.apply_filters(table(spark, sf, "orders"), CHAIN)
    return charts.bar(kept, "o_orderpriority", "o_totalprice").selectExpr(
        "o_orderpriority", "round(height, 2) AS revenue"
    )


@query(
    "f9_filter_summary",
    f"""
    SELECT count(*) AS total, count(*) FILTER (WHERE {CHAIN_WHERE}) AS kept,
           round(count(*) FILTER (WHERE {CHAIN_WHERE}) * 100.0 / count(*), 1) AS kept_pct
    FROM orders
    """,
)
def filter_summary(spark, sf):
    return ops.filter_summary(table(spark, sf, "orders"), CHAIN)


@query(
    "f9_filter_summary_sql",
    f"""
    SELECT count(*) AS total, count(*) FILTER (WHERE o_custkey % 2 = 0 AND {CHAIN_WHERE}) AS kept,
           round(count(*) FILTER (WHERE o_custkey % 2 = 0 AND {CHAIN_WHERE}) * 100.0 / count(*), 1) AS kept_pct
    FROM orders
    """,
)
def filter_summary_sql(spark, sf):
    return ops.filter_summary(table(spark, sf, "orders"), CHAIN, "SELECT * FROM df WHERE o_custkey % 2 = 0")


@query(
    "f10_domains",
    """
    SELECT 'l_orderkey' AS "column", 'numeric' AS role, CAST(min(l_orderkey) AS VARCHAR) AS min_value,
           CAST(max(l_orderkey) AS VARCHAR) AS max_value, CAST(NULL AS VARCHAR) AS choices FROM lineitem
    UNION ALL SELECT 'l_linenumber', 'numeric', CAST(min(l_linenumber) AS VARCHAR),
           CAST(max(l_linenumber) AS VARCHAR), NULL FROM lineitem
    UNION ALL SELECT 'l_linestatus', 'categorical', NULL, NULL,
           string_agg(DISTINCT l_linestatus, '|' ORDER BY l_linestatus) FROM lineitem
    UNION ALL SELECT 'l_quantity', 'numeric', CAST(min(l_quantity) AS VARCHAR),
           CAST(max(l_quantity) AS VARCHAR), NULL FROM lineitem
    UNION ALL SELECT 'returned', 'boolean', NULL, NULL, 'false|true'
    """,
)
def domains(spark, sf):
    found = ops.filter_domains(flagged_lines(spark, sf))
    return found.selectExpr("column", "role", "min_value", "max_value", "array_join(choices, '|') AS choices")


@query(
    "f11_reset",
    """SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus""",
)
def reset(spark, sf):
    from tablewright.dataset import Dataset

    data = Dataset.of(table(spark, sf, "orders")).filter(CHAIN).reset_filters()
    return data.filtered.groupBy("o_orderstatus").count().withColumnRenamed("count", "n")


@query(
    "f2_categorical_in_long",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey <= 5000 AND o_custkey % 2 = 1",
)
def categorical_in_long(spark, sf):
    wanted = list(range(1, 5001, 2))
    return ops.OneOf("o_custkey", wanted).apply(table(spark, sf, "orders").select("o_orderkey", "o_custkey"))


@query(
    "f5_search_numbers",
    "SELECT * FROM (SELECT o_orderkey, round(o_totalprice * 100) AS cents FROM orders) "
    "WHERE CAST(CAST(cents AS BIGINT) AS VARCHAR) || '.0' LIKE '%7.0%'",
)
def search_numbers(spark, sf):
    cents = table(spark, sf, "orders").selectExpr("o_orderkey", "round(o_totalprice * 100) AS cents")
    return ops.TextSearch("7.0", ["cents"], literal=True).apply(cents)


@query("f7_sql_semicolon", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000")
def sql_semicolon(spark, sf):
    text = "SELECT o_orderkey, o_totalprice FROM df WHERE o_totalprice > 400000;"
    return ops.apply_filters(table(spark, sf, "orders"), [], sql=text)
