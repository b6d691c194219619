"""Queries on feature engineering."""

from pyspark.sql import functions as F

from tablewright.dataset import Dataset
from tablewright.operators import features as ops
from tablewright.operators.filters import NumericRange
from tablewright.plans.registry import GAPS_SQL, line_numbers, orders_with_gaps, query, table


@query(
    "g7_rebuild",
    "SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem WHERE l_quantity BETWEEN 10 AND 20",
)
def rebuild(spark, sf):
    """Filter, engineer, filter anew: the feature table starts over from the filtered one."""
    data = Dataset.of(line_numbers(spark, sf)).filter([NumericRange("l_quantity", 1.0, 5.0)])
    data = data.engineered(lambda df: ops.log_transform(df, ["l_tax"]))
    return data.filter([NumericRange("l_quantity", 10.0, 20.0)]).model


@query(
    "g1_scale_standard",
    GAPS_SQL
    + """
    SELECT o_orderkey, round((price - (SELECT avg(price) FROM gaps)) / (SELECT stddev_pop(price) FROM gaps), 6) AS price
    FROM gaps
    """,
)
def scale_standard(spark, sf):
    scaled, _ = ops.scale(orders_with_gaps(spark, sf), ["price"])
    return scaled.select("o_orderkey", F.round("price", 6).alias("price"))


@query(
    "g2_scale_minmax",
    """
    SELECT c_custkey, round((c_acctbal - lo) / (hi - lo), 6) AS c_acctbal
    FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)
    """,
)
def scale_minmax(spark, sf):
    scaled, _ = ops.scale(table(spark, sf, "customer"), ["c_acctbal"], "minmax")
    return scaled.select("c_custkey", F.round("c_acctbal", 6).alias("c_acctbal"))


@query(
    "g3_log1p",
    """
    SELECT c_custkey, round(ln(1 + c_acctbal + CASE WHEN lo <= -1 THEN abs(lo) + 1 ELSE 0 END), 6) AS c_acctbal,
           round(ln(1 + c_custkey), 6) AS logged_key
    FROM customer, (SELECT min(c_acctbal) AS lo FROM customer)
    """,
)
def log1p(spark, sf):
    customers = table(spark, sf, "customer").withColumn("logged_key", F.col("c_custkey"))
    logged = ops.log_transform(customers, ["c_acctbal", "logged_key"])
    return logged.select(
        "c_custkey", F.round("c_acctbal", 6).alias("c_acctbal"), F.round("logged_key", 6).alias("logged_key")
    )


@query(
    "g4_onehot",
    GAPS_SQL
    + """
    SELECT o_orderkey, coalesce(status = 'F', false) AS "status_F", coalesce(status = 'O', false) AS "status_O",
           coalesce(status = 'P', false) AS "status_P" FROM gaps
    """,
)
def onehot(spark, sf):
    orders = orders_with_gaps(spark, sf).select("o_orderkey", "status")
    encoded, _ = ops.encode_categorical(orders, ["status"], "onehot")
    return encoded


@query(
    "g4_onehot_vector",
    """
    SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS BIGINT) AS position FROM part
    """,
)
def onehot_vector(spark, sf):
    from pyspark.ml.functions import vector_to_array

    encoded = ops.one_hot_vector(table(spark, sf, "part").select("p_partkey", "p_brand"), ["p_brand"])
    flags = vector_to_array("p_brand_onehot")
    return encoded.select("p_partkey", (F.array_position(flags, 1.0) - 1).alias("position"))


_LABELS_SQL = (
    GAPS_SQL
    + """, texts AS (SELECT o_orderkey, coalesce(status, 'None') AS status FROM gaps)
    """
)


@query(
    "g5_label",
    _LABELS_SQL
    + "SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY status) - 1 AS BIGINT) AS status FROM texts",
)
def label(spark, sf):
    encoded, _ = ops.encode_categorical(
        orders_with_gaps(spark, sf).select("o_orderkey", "status"), ["status"], "label"
    )
    return encoded


@query("g5_label_inverse", _LABELS_SQL + "SELECT o_orderkey, status FROM texts")
def label_inverse(spark, sf):
    encoded, classes = ops.label_encode(orders_with_gaps(spark, sf).select("o_orderkey", "status"), ["status"])
    return ops.label_decode(encoded, classes)


@query(
    "g5_label_many_values",
    """
    SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_name) - 1 AS BIGINT) AS c_name FROM customer
    """,
)
def label_many_values(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_name")
    encoded, _ = ops.label_encode(customers, ["c_name"], limit=100)
    return encoded


@query(
    "g6_corr_select",
    """
    SELECT feature FROM (
      SELECT 'l_quantity' AS feature, corr(l_quantity, charge) AS c FROM (SELECT *, l_quantity * 2 + l_tax AS charge FROM lineitem)
      UNION ALL SELECT 'l_extendedprice', corr(l_extendedprice, charge) FROM (SELECT *, l_quantity * 2 + l_tax AS charge FROM lineitem)
      UNION ALL SELECT 'l_discount', corr(l_discount, charge) FROM (SELECT *, l_quantity * 2 + l_tax AS charge FROM lineitem)
      UNION ALL SELECT 'l_tax', corr(l_tax, charge) FROM (SELECT *, l_quantity * 2 + l_tax AS charge FROM lineitem))
    WHERE abs(c) > 0.8
    """,
)
def corr_select(spark, sf):
    lines = line_numbers(spark, sf).withColumn("charge", F.col("l_quantity") * 2 + F.col("l_tax"))
    chosen = ops.correlated_features(lines, "charge")
    return spark.createDataFrame([(c,) for c in chosen], "feature string")
