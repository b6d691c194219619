"""Queries on profiles and key figures."""

from pyspark.sql import functions as F

from tablewright.operators import profile as ops
from tablewright.plans.registry import GAPS_SQL, flagged_lines, line_numbers, orders_with_gaps, query, table

_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _numeric_sql(source, column):
    return f"""
    SELECT '{column}' AS "column", count({column}) AS count, round(avg({column}), 4) AS mean,
           round(stddev_samp({column}), 4) AS std, round(min({column}), 4) AS min,
           round(quantile_cont({column}, 0.25), 4) AS p25, round(quantile_cont({column}, 0.5), 4) AS p50,
           round(quantile_cont({column}, 0.75), 4) AS p75, round(max({column}), 4) AS max,
           round(skewness({column}), 4) AS skew, round(kurtosis({column}), 4) AS kurtosis
    FROM {source}
    """


@query("e1_numeric_summary", " UNION ALL ".join(_numeric_sql("lineitem", c) for c in _NUMBERS))
def numeric_summary(spark, sf):
    return ops.numeric_summary(line_numbers(spark, sf))


@query("e1_numeric_summary_gaps", GAPS_SQL + _numeric_sql("gaps", "price"))
def numeric_summary_gaps(spark, sf):
    return ops.numeric_summary(orders_with_gaps(spark, sf), ["price"])


def _categorical_sql(source, column):
    return f"""
    SELECT '{column}' AS "column", count(value) AS unique_values,
           arg_min(coalesce(value, '<missing>'), rank) AS most_frequent, max(n) AS freq_count
    FROM (SELECT value, n, row_number() OVER (ORDER BY n DESC, value NULLS LAST) AS rank FROM (
      SELECT CAST({column} AS VARCHAR) AS value, count(*) AS n FROM {source} GROUP BY 1))
    """


@query(
    "e2_categorical_summary",
    GAPS_SQL
    + ", lines AS (SELECT l_linestatus, l_returnflag = 'R' AS returned FROM lineitem) "
    + _categorical_sql("gaps", "status")
    + " UNION ALL "
    + _categorical_sql("lines", "l_linestatus")
    + " UNION ALL "
    + _categorical_sql("lines", "returned"),
)
def categorical_summary(spark, sf):
    both = ops.categorical_summary(orders_with_gaps(spark, sf)).unionByName(
        ops.categorical_summary(flagged_lines(spark, sf))
    )
    return both.withColumn("most_frequent", F.coalesce("most_frequent", F.lit("<missing>")))


@query(
    "e2_categorical_summary_wide",
    " UNION ALL ".join(_categorical_sql("part", c) for c in ("p_name", "p_brand", "p_type")),
)
def categorical_summary_wide(spark, sf):
    return ops.categorical_summary(table(spark, sf, "part"))


def _corr_sql(source, columns):
    parts = []
    for a in columns:
        for b in columns:
            parts.append(
                f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS corr FROM {source}"
            )
    return " UNION ALL ".join(parts)


@query("e3_corr_matrix", _corr_sql("lineitem", _NUMBERS))
def corr_matrix(spark, sf):
    return ops.correlation_matrix(line_numbers(spark, sf)).withColumn("corr", F.round("corr", 6))


@query("e3_corr_subset_gaps", GAPS_SQL + _corr_sql("gaps", ("price", "customer")))
def corr_subset(spark, sf):
    found = ops.correlation_matrix(orders_with_gaps(spark, sf), ["price", "customer"])
    return found.withColumn("corr", F.round("corr", 6))


@query(
    "e4_corr_pair",
    "SELECT round(corr(l_quantity, l_extendedprice), 6) AS corr FROM lineitem",
)
def corr_pair(spark, sf):
    found = ops.pair_correlation(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return found.withColumn("corr", F.round("corr", 6))


@query(
    "e5_missing_mask",
    GAPS_SQL
    + """
    SELECT o_orderkey, CAST(price IS NULL AS INTEGER) AS price, CAST(status IS NULL AS INTEGER) AS status,
           CAST(customer IS NULL AS INTEGER) AS customer FROM gaps
    """,
)
def missing_mask(spark, sf):
    return ops.missing_mask(orders_with_gaps(spark, sf), keys=["o_orderkey"])


@query(
    "e5_missing_patterns",
    GAPS_SQL
    + """
    SELECT CAST(price IS NULL AS INTEGER) AS price, CAST(status IS NULL AS INTEGER) AS status,
           CAST(customer IS NULL AS INTEGER) AS customer, count(*) AS row_count
    FROM gaps GROUP BY 1, 2, 3
    """,
)
def missing_patterns(spark, sf):
    return ops.missing_patterns(orders_with_gaps(spark, sf), ["price", "status", "customer"])


@query(
    "e5_missing_rates",
    GAPS_SQL
    + """, b AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM gaps)
    SELECT CAST(least(floor((o_orderkey - lo) / ((hi - lo) / 30.0)), 29) AS BIGINT) AS bucket, count(*) AS row_count,
           round(avg(CAST(price IS NULL AS INTEGER)), 6) AS price, round(avg(CAST(status IS NULL AS INTEGER)), 6) AS status,
           round(avg(CAST(customer IS NULL AS INTEGER)), 6) AS customer
    FROM gaps, b GROUP BY 1
    """,
)
def missing_rates(spark, sf):
    found = ops.missing_rates(orders_with_gaps(spark, sf), "o_orderkey")
    return found.withColumns({c: F.round(c, 6) for c in ("price", "status", "customer")})


@query(
    "k_kpis",
    GAPS_SQL
    + """
    SELECT count(*) AS row_count, CAST(4 AS BIGINT) AS column_count,
           3 * count(*) - count(price) - count(status) - count(customer) AS missing_values,
           round(avg(price), 4) AS mean, round(quantile_cont(price, 0.5), 4) AS median,
           round(sum(price), 2) AS sum, count(DISTINCT status) AS "unique"
    FROM gaps
    """,
)
def kpis(spark, sf):
    found = ops.key_figures(
        orders_with_gaps(spark, sf), mean_of="price", median_of="price", sum_of="price", unique_of="status"
    )
    return found.withColumns(
        {"mean": F.round("mean", 4), "median": F.round("median", 4), "sum": F.round("sum", 2)}
    )


# Twenty columns, each with gaps in other rows.
_GAPPED = {
    f"c{i}": f"CASE WHEN (l_orderkey + l_linenumber) % {i + 3} = 0 THEN NULL ELSE {base} * {i + 1} + l_linenumber END"
    for i, base in enumerate(["l_quantity", "l_extendedprice", "l_discount", "l_tax"] * 5)
}
_GAPPED_PAIRS = ", ".join(
    f"struct_pack(col_a := '{a}', col_b := '{b}', corr := {'1.0::DOUBLE' if a == b else f'round(corr({a}, {b}), 6)'})"
    for a in _GAPPED
    for b in _GAPPED
)


@query(
    "e3_corr_wide_gaps",
    f"""
    WITH gapped AS (SELECT {", ".join(f"{text} AS {name}" for name, text in _GAPPED.items())} FROM lineitem),
    pairs AS (SELECT [{_GAPPED_PAIRS}] AS found FROM gapped)
    SELECT p.col_a AS col_a, p.col_b AS col_b, p.corr AS corr FROM (SELECT unnest(found) AS p FROM pairs)
    """,
)
def corr_wide_gaps(spark, sf):
    gapped = table(spark, sf, "lineitem").selectExpr(*[f"{text} AS {name}" for name, text in _GAPPED.items()])
    return ops.correlation_matrix(gapped).withColumn("corr", F.round("corr", 6))
