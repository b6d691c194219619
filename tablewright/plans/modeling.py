"""Queries on models, their metrics and forecasts."""

from pyspark.sql import functions as F

from tablewright.operators import forecast as series
from tablewright.operators import metrics
from tablewright.operators import modeling as ops
from tablewright.plans.registry import GAPS_SQL, orders_with_gaps, query, table
from tablewright.session import scratch_path


@query(
    "m1_problem_type",
    """
    SELECT * FROM (
      SELECT 'o_totalprice' AS target, CASE WHEN count(DISTINCT o_totalprice) > 10 THEN 'regression' ELSE 'classification' END AS problem FROM orders
      UNION ALL SELECT 'o_orderstatus', 'classification'
      UNION ALL SELECT 'l_linenumber', CASE WHEN count(DISTINCT l_linenumber) > 10 THEN 'regression' ELSE 'classification' END FROM lineitem
      UNION ALL SELECT 'l_discount', CASE WHEN count(DISTINCT l_discount) > 10 THEN 'regression' ELSE 'classification' END FROM lineitem
      UNION ALL SELECT 'l_tax', CASE WHEN count(DISTINCT l_tax) > 10 THEN 'regression' ELSE 'classification' END FROM lineitem)
    """,
)
def problem_type(spark, sf):
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    rows = [(t, ops.problem_type(orders, t)) for t in ("o_totalprice", "o_orderstatus")]
    rows += [(t, ops.problem_type(lines, t)) for t in ("l_linenumber", "l_discount", "l_tax")]
    return spark.createDataFrame(rows, "target string, problem string")


@query(
    "m2_prepared",
    GAPS_SQL
    + """
    SELECT CAST(o.o_orderkey AS DOUBLE) AS o_orderkey, round(coalesce(g.price, (SELECT avg(price) FROM gaps)), 4) AS price,
           CAST(epoch_us(o.o_orderdate) * 1000 AS DOUBLE) AS o_orderdate,
           CAST(coalesce(g.status = 'O', false) AS DOUBLE) AS "status_O",
           CAST(coalesce(g.status = 'P', false) AS DOUBLE) AS "status_P", o.o_orderpriority
    FROM orders o JOIN gaps g ON o.o_orderkey = g.o_orderkey
    """,
)
def prepared(spark, sf):
    rows = table(spark, sf, "orders").selectExpr(
        "o_orderkey",
        "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price",
        "o_orderdate",
        "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS status",
        "o_orderpriority",
    )
    return ops.design_matrix(rows, "o_orderpriority").withColumn("price", F.round("price", 4))


@query(
    "m3_split",
    "SELECT count(*) AS row_count, count(*) AS placed, CAST(0 AS BIGINT) AS in_both, true AS share_as_asked FROM orders",
)
def split(spark, sf):
    """The two parts cover the table, share no row and have the asked sizes."""
    orders = table(spark, sf, "orders")
    train, test = ops.hash_split(orders, ["o_orderkey"], 0.2)
    parts = train.select("o_orderkey", F.lit(0).alias("part")).unionByName(
        test.select("o_orderkey", F.lit(1).alias("part"))
    )
    per_key = parts.groupBy("o_orderkey").agg(F.count("*").alias("n"), F.max("part").alias("part"))
    return per_key.agg(
        F.lit(orders.count()).cast("bigint").alias("row_count"),
        F.sum("n").alias("placed"),
        F.count_if(F.col("n") > 1).alias("in_both"),
        F.avg("part").between(0.15, 0.25).alias("share_as_asked"),
    )


@query("m3_split_rows")
def split_rows(spark, sf):
    _, test = ops.hash_split(table(spark, sf, "orders"), ["o_orderkey"], 0.2)
    return test.select("o_orderkey", "o_totalprice")


def _metric_table(spark, model):
    rows = [(model.algorithm, model.problem, k, float(v)) for k, v in model.metrics.items()]
    return spark.createDataFrame(rows, "algorithm string, problem string, metric string, value double")


@query(
    "m4_linear",
    "SELECT 'l_quantity' AS feature, round(abs(regr_slope(l_extendedprice, l_quantity)), 4) AS importance FROM lineitem",
)
def linear(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice")
    model = ops.fit(lines, "l_extendedprice", "Linear Regression")
    return ops.feature_importance(model).withColumn("importance", F.round("importance", 4))


@query("m4_linear_metrics")
def linear_metrics(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"
    )
    return _metric_table(
        spark, ops.train(lines, "l_extendedprice", "Linear Regression", split_keys=["l_orderkey", "l_linenumber"])
    )


# A target that leans to another class in each order state.  A classifier that
# sees the state only must answer with the most frequent class of the state.
_LEANING = {
    2: """CASE WHEN (o_custkey % 10 < 7) = (o_orderstatus = 'F') THEN 'yes' ELSE 'no' END""",
    3: """CASE WHEN o_custkey % 10 < 7 THEN o_orderstatus
               WHEN o_custkey % 10 < 9 THEN CASE o_orderstatus WHEN 'F' THEN 'O' WHEN 'O' THEN 'P' ELSE 'F' END
               ELSE CASE o_orderstatus WHEN 'F' THEN 'P' WHEN 'O' THEN 'F' ELSE 'O' END END""",
}


def _majority_sql(classes):
    return f"""
    WITH leaning AS (SELECT o_orderstatus, {_LEANING[classes]} AS answer FROM orders),
    ranked AS (SELECT o_orderstatus, answer, sum(count(*)) OVER (PARTITION BY o_orderstatus) AS n,
                      row_number() OVER (PARTITION BY o_orderstatus ORDER BY count(*) DESC) AS place
               FROM leaning GROUP BY o_orderstatus, answer)
    SELECT o_orderstatus, answer AS prediction, CAST(n AS BIGINT) AS n FROM ranked WHERE place = 1
    """


def _scores_sql(classes):
    """Accuracy and weighted scores of the most frequent class of each state."""
    return f"""
    WITH leaning AS (SELECT o_orderstatus, {_LEANING[classes]} AS answer FROM orders),
    ranked AS (SELECT o_orderstatus, answer AS prediction,
                      row_number() OVER (PARTITION BY o_orderstatus ORDER BY count(*) DESC) AS place
               FROM leaning GROUP BY o_orderstatus, answer),
    pairs AS (SELECT answer, prediction FROM leaning JOIN ranked USING (o_orderstatus) WHERE place = 1),
    c AS (SELECT k, count(*) FILTER (WHERE answer = k) AS actual, count(*) FILTER (WHERE prediction = k) AS predicted,
                 count(*) FILTER (WHERE answer = k AND prediction = k) AS hits
          FROM pairs, (SELECT DISTINCT answer AS k FROM leaning) GROUP BY k)
    SELECT round(sum(hits) / sum(actual), 6) AS accuracy,
           round(sum(coalesce(2.0 * hits / nullif(actual + predicted, 0), 0) * actual) / sum(actual), 6) AS f1,
           round(sum(coalesce(hits * 1.0 / nullif(predicted, 0), 0) * actual) / sum(actual), 6) AS "precision",
           round(sum(coalesce(hits * 1.0 / nullif(actual, 0), 0) * actual) / sum(actual), 6) AS recall
    FROM c
    """


def _scores_query(name, algorithm, classes):
    @query(name, _scores_sql(classes))
    def run(spark, sf):
        leaning = table(spark, sf, "orders").selectExpr("o_orderstatus", f"{_LEANING[classes]} AS answer")
        found = ops.evaluate(ops.fit(leaning, "answer", algorithm), leaning)
        return spark.createDataFrame([{k: round(v, 6) for k, v in found.items()}])


def _classifier_query(name, algorithm, classes, rounds=ops.ROUNDS):
    @query(name, _majority_sql(classes))
    def run(spark, sf):
        orders = table(spark, sf, "orders")
        leaning = orders.selectExpr("o_orderstatus", f"{_LEANING[classes]} AS answer")
        model = ops.fit(leaning, "answer", algorithm, rounds=rounds)
        scored = model.score(orders.select("o_orderstatus"))
        return scored.groupBy("o_orderstatus", "prediction").agg(F.count("*").alias("n"))


_classifier_query("m5_logistic", "Logistic Regression", 2)
_classifier_query("m5_logistic_many_classes", "Logistic Regression", 3)
_classifier_query("m6_forest", "Random Forest", 3)
_classifier_query("m7_gbt", "XGBoost", 2)
_classifier_query("m7_gbt_many_classes", "XGBoost", 3)
_scores_query("m5_logistic_scores", "Logistic Regression", 3)
_scores_query("m6_forest_scores", "Random Forest", 3)
_scores_query("m7_gbt_scores", "XGBoost", 2)
_scores_query("m7_gbt_many_scores", "XGBoost", 3)


# The first tree of a boosted regression with one split: of all limits between quantities the one with
# the largest gain, where a leaf of n rows is worth its sum of gaps to the mean, shrunk by n + 1.
_STUMP_SQL = """
    WITH mean AS (SELECT avg(l_extendedprice) AS m FROM lineitem),
    per AS (SELECT l_quantity AS q, count(*) AS n, sum(l_extendedprice - m) AS g FROM lineitem, mean GROUP BY 1),
    sides AS (SELECT q, coalesce(sum(n) OVER below, 0) AS ln, coalesce(sum(g) OVER below, 0) AS lg,
                     sum(n) OVER () AS n, sum(g) OVER () AS g
              FROM per WINDOW below AS (ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    best AS (SELECT q, 0.1 * lg / (ln + 1) AS low, 0.1 * (g - lg) / (n - ln + 1) AS high
             FROM sides WHERE ln > 0
             ORDER BY lg * lg / (ln + 1) + (g - lg) * (g - lg) / (n - ln + 1) DESC, q LIMIT 1),
    scored AS (SELECT l_quantity, l_extendedprice, m + CASE WHEN l_quantity < q THEN low ELSE high END AS prediction
               FROM lineitem, mean, best)
"""


def _stump(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice")
    return lines, ops.fit(lines, "l_extendedprice", "XGBoost", rounds=1, trees={"max_depth": 1})


@query(
    "m7_gbt_first_split",
    _STUMP_SQL
    + "SELECT l_quantity, count(*) AS n, round(any_value(prediction), 4) AS prediction FROM scored GROUP BY l_quantity",
)
def gbt_first_split(spark, sf):
    """One round with one split, as its sums give it."""
    lines, model = _stump(spark, sf)
    return (
        model.score(lines)
        .groupBy("l_quantity")
        .agg(F.count("*").alias("n"), F.round(F.max("prediction"), 4).alias("prediction"))
    )


@query(
    "m7_gbt_first_split_metrics",
    _STUMP_SQL
    + """
    SELECT round(sqrt(avg(pow(l_extendedprice - prediction, 2))), 3) AS rmse,
           round(1 - avg(pow(l_extendedprice - prediction, 2)) / var_pop(l_extendedprice), 6) AS r2
    FROM scored
    """,
)
def gbt_first_split_metrics(spark, sf):
    lines, model = _stump(spark, sf)
    found = ops.evaluate(model, lines)
    return spark.createDataFrame([(round(found["rmse"], 3), round(found["r2"], 6))], "rmse double, r2 double")


@query(
    "m4_linear_scores",
    """
    SELECT round(sqrt((regr_syy(l_extendedprice, l_quantity)
                       - pow(regr_sxy(l_extendedprice, l_quantity), 2) / regr_sxx(l_extendedprice, l_quantity)) / count(*)), 3) AS rmse,
           round(regr_r2(l_extendedprice, l_quantity), 6) AS r2
    FROM lineitem
    """,
)
def linear_scores(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice")
    found = ops.evaluate(ops.fit(lines, "l_extendedprice", "Linear Regression"), lines)
    return spark.createDataFrame([(round(found["rmse"], 3), round(found["r2"], 6))], "rmse double, r2 double")


@query(
    "m13_save_load",
    """
    SELECT l_quantity, round(any_value(a) + any_value(b) * l_quantity, 3) AS prediction
    FROM lineitem, (SELECT regr_intercept(l_extendedprice, l_quantity) AS a,
                           regr_slope(l_extendedprice, l_quantity) AS b FROM lineitem)
    GROUP BY l_quantity
    """,
)
def save_load(spark, sf):
    """A model that was written and read again scores the table."""
    lines = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice")
    path = scratch_path(spark, "model")
    ops.fit(lines, "l_extendedprice", "Linear Regression").save(path)
    scored = ops.TrainedModel.load(path).score(lines.select("l_quantity"))
    return scored.groupBy("l_quantity").agg(F.round(F.max("prediction"), 3).alias("prediction"))


@query("m5_logistic_metrics")
def logistic_metrics(spark, sf):
    orders = orders_with_gaps(spark, sf)
    return _metric_table(spark, ops.train(orders, "status", "Logistic Regression", split_keys=["o_orderkey"]))


@query("m6_forest_metrics")
def forest_metrics(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    return _metric_table(spark, ops.train(events, "value", "Random Forest", split_keys=["event_id"]))


@query("m7_gbt_metrics")
def gbt_metrics(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")
    return _metric_table(spark, ops.train(parts, "p_retailprice", "XGBoost", split_keys=["p_partkey"]))


@query(
    "m8_cls_metrics",
    """
    WITH c AS (SELECT CAST(q AS INTEGER) AS class,
                      count(*) FILTER (WHERE quality = q) AS actual, count(*) FILTER (WHERE toxic = q) AS predicted,
                      count(*) FILTER (WHERE quality = q AND toxic = q) AS hits
               FROM labels, range(2) AS r(q) GROUP BY q)
    SELECT round(sum(hits) / sum(actual), 6) AS accuracy,
           round(sum(coalesce(2.0 * hits / nullif(actual + predicted, 0), 0) * actual) / sum(actual), 6) AS f1,
           round(sum(coalesce(hits * 1.0 / nullif(predicted, 0), 0) * actual) / sum(actual), 6) AS "precision",
           round(sum(coalesce(hits * 1.0 / nullif(actual, 0), 0) * actual) / sum(actual), 6) AS recall
    FROM c
    """,
)
def cls_metrics(spark, sf):
    found = metrics.classification_metrics(table(spark, sf, "labels"), "quality", "toxic")
    return found.select([F.round(c, 6).alias(c) for c in found.columns])


@query(
    "m9_reg_metrics",
    """
    SELECT round(sqrt(avg(pow(l_extendedprice - p, 2))), 4) AS rmse,
           round(1 - avg(pow(l_extendedprice - p, 2)) / var_pop(l_extendedprice), 6) AS r2
    FROM (SELECT l_extendedprice, 2000 * l_quantity AS p FROM lineitem)
    """,
)
def reg_metrics(spark, sf):
    guessed = table(spark, sf, "lineitem").withColumn("guess", 2000 * F.col("l_quantity"))
    found = metrics.regression_metrics(guessed, "l_extendedprice", "guess")
    return found.select(F.round("rmse", 4).alias("rmse"), F.round("r2", 6).alias("r2"))


@query(
    "m10_importance",
    """
    WITH c AS (SELECT covar_pop(l_quantity, l_extendedprice) AS s1y, covar_pop(l_discount, l_extendedprice) AS s2y,
                      var_pop(l_quantity) AS s11, var_pop(l_discount) AS s22, covar_pop(l_quantity, l_discount) AS s12
               FROM lineitem)
    SELECT 'l_quantity' AS feature, round(abs((s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12)), 3) AS importance FROM c
    UNION ALL SELECT 'l_discount', round(abs((s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12)), 3) FROM c
    """,
)
def importance(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_extendedprice")
    found = ops.feature_importance(ops.fit(lines, "l_extendedprice", "Linear Regression"))
    return found.withColumn("importance", F.round("importance", 3))


@query("m10_importance_trees")
def importance_trees(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_returnflag", "l_extendedprice")
    return ops.feature_importance(ops.fit(lines, "l_extendedprice", "Random Forest"), top=20)


@query(
    "m11_score",
    """
    SELECT l_quantity, count(*) AS n, round(any_value(a) + any_value(b) * l_quantity, 3) AS prediction
    FROM lineitem, (SELECT regr_intercept(l_extendedprice, l_quantity) AS a,
                           regr_slope(l_extendedprice, l_quantity) AS b FROM lineitem)
    GROUP BY l_quantity
    """,
)
def score(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice")
    model = ops.fit(lines, "l_extendedprice", "Linear Regression")
    scored = model.score(lines.select("l_quantity"))
    return scored.groupBy("l_quantity").agg(
        F.count("*").alias("n"), F.round(F.max("prediction"), 3).alias("prediction")
    )


@query(
    "m12_defaults",
    GAPS_SQL
    + """
    SELECT 'price' AS "column", CAST(round(avg(price), 4) AS VARCHAR) AS value FROM gaps
    UNION ALL SELECT 'customer', CAST(round(avg(customer), 4) AS VARCHAR) FROM gaps
    UNION ALL SELECT 'status', (SELECT status FROM gaps WHERE status IS NOT NULL
                                GROUP BY status ORDER BY count(*) DESC, status LIMIT 1)
    """,
)
def defaults(spark, sf):
    found = ops.default_value_table(orders_with_gaps(spark, sf), ["price", "customer", "status"])
    mean = F.round(F.col("value").try_cast("double"), 4).cast("string")
    return found.select("column", F.coalesce(mean, "value").alias("value"))


@query(
    "x1_daily_series",
    """
    SELECT event_type, strftime(ts, '%Y-%m-%d') AS ds, round(avg(value), 6) AS y, count(*) AS n
    FROM events GROUP BY 1, 2
    """,
)
def daily_series(spark, sf):
    found = series.daily_series(table(spark, sf, "events"), "ts", "value", by=["event_type"])
    return found.select("event_type", F.date_format("ds", "yyyy-MM-dd").alias("ds"), F.round("y", 6).alias("y"), "n")


@query(
    "x1_daily_spread",
    """
    SELECT event_type, CAST(sum(n) AS BIGINT) AS n, round(sum(n * y), 2) AS total, round(sum(within), 2) AS within
    FROM (SELECT event_type, CAST(ts AS DATE) AS ds, avg(value) AS y, CAST(count(*) AS BIGINT) AS n,
                 var_pop(value) * count(*) AS within FROM events GROUP BY 1, 2)
    GROUP BY event_type
    """,
)
def daily_spread(spark, sf):
    """What a forecast knows of the single rows: their number, sum and spread within the days."""
    days = series.daily_series(table(spark, sf, "events"), "ts", "value", by=["event_type"])
    return days.groupBy("event_type").agg(
        F.sum("n").alias("n"),
        F.round(F.sum(F.col("n") * F.col("y")), 2).alias("total"),
        F.round(F.sum("within"), 2).alias("within"),
    )


@query(
    "x1_forecast_coverage",
    """
    SELECT count(DISTINCT CAST(o_orderdate AS DATE)) + 30 AS days, true AS ordered, true AS covered FROM orders
    """,
)
def forecast_coverage(spark, sf):
    """Days of a forecast, order of its bounds, and that the interval holds about 80 % of the days."""
    orders = table(spark, sf, "orders")
    found = series.forecast(orders, "o_orderdate", "o_totalprice", 30, aggregation="sum")
    days = series.daily_series(orders, "o_orderdate", "o_totalprice", aggregation="sum").select("ds", "y")
    inside = F.col("y").between(F.col("yhat_lower"), F.col("yhat_upper")).cast("double")
    return found.join(days, "ds", "left").agg(
        F.count("*").alias("days"),
        F.every((F.col("yhat_lower") <= F.col("yhat")) & (F.col("yhat") <= F.col("yhat_upper"))).alias("ordered"),
        F.avg(inside).between(0.7, 0.9).alias("covered"),
    )


@query(
    "x1_trend",
    """
    SELECT count(*) AS days, round(regr_slope(y, d), 4) AS slope, round(regr_intercept(y, d), 2) AS intercept,
           round(regr_r2(y, d), 6) AS r2
    FROM (SELECT CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS d,
                 sum(o_totalprice) AS y FROM orders GROUP BY 1)
    """,
)
def trend(spark, sf):
    days = series.daily_series(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", aggregation="sum")
    return series.linear_trend(days).select(
        "days", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"), F.round("r2", 6).alias("r2")
    )


@query("x1_forecast")
def forecast(spark, sf):
    return series.forecast(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", 30, aggregation="sum")


@query(
    "x1_forecast_days",
    """
    WITH days AS (SELECT event_type, CAST(ts AS DATE) AS d FROM events GROUP BY 1, 2)
    SELECT event_type, count(*) + 14 AS days, strftime(min(d), '%Y-%m-%d') AS first_day,
           strftime(max(d) + INTERVAL 14 DAY, '%Y-%m-%d') AS last_day, CAST(0 AS BIGINT) AS misplaced
    FROM days GROUP BY event_type
    """,
)
def forecast_days(spark, sf):
    """Which days a forecast covers, and that every estimate lies inside its interval."""
    found = series.forecast(table(spark, sf, "events"), "ts", "value", 14, by=["event_type"])
    return found.groupBy("event_type").agg(
        F.count_distinct("ds").alias("days"),
        F.date_format(F.min("ds"), "yyyy-MM-dd").alias("first_day"),
        F.date_format(F.max("ds"), "yyyy-MM-dd").alias("last_day"),
        F.count_if(~F.col("yhat").between(F.col("yhat_lower"), F.col("yhat_upper"))).alias("misplaced"),
    )


@query("x1_forecast_by_key")
def forecast_by_key(spark, sf):
    return series.forecast(table(spark, sf, "events"), "ts", "value", 14, by=["event_type"])


@query("x1_forecast_rows")
def forecast_rows(spark, sf):
    """Single events with a season within the day, 14 days ahead."""
    return series.forecast_rows(table(spark, sf, "events"), "ts", "value", 14, by=["event_type"])


@query(
    "x1_forecast_rows_fit",
    """
    SELECT event_type, count(DISTINCT ts) + 14 AS stamps, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_stamp,
           strftime(max(ts) + INTERVAL 14 DAY, '%Y-%m-%d %H:%M:%S') AS last_stamp, CAST(0 AS BIGINT) AS misplaced,
           true AS same_mean, true AS smaller_spread
    FROM events GROUP BY event_type
    """,
)
def forecast_rows_fit(spark, sf):
    """Stamps of the estimates, and that they keep the mean of the single rows and explain some of their spread."""
    events = table(spark, sf, "events").select("event_type", "ts", "value")
    found = series.forecast_rows(events, "ts", "value", 14, by=["event_type"])
    shape = found.groupBy("event_type").agg(
        F.count("*").alias("stamps"),
        F.date_format(F.min("ds"), "yyyy-MM-dd HH:mm:ss").alias("first_stamp"),
        F.date_format(F.max("ds"), "yyyy-MM-dd HH:mm:ss").alias("last_stamp"),
        F.count_if(~F.col("yhat").between(F.col("yhat_lower"), F.col("yhat_upper"))).alias("misplaced"),
    )
    both = events.join(found, (events["event_type"] == found["event_type"]) & (events["ts"] == found["ds"]))
    gap = F.col("value") - F.col("yhat")
    fit = both.groupBy(events["event_type"]).agg(
        (F.abs(F.avg(gap)) < 0.01 * F.avg("value")).alias("same_mean"),
        (F.avg(gap * gap) < F.var_pop("value")).alias("smaller_spread"),
    )
    return shape.join(fit, "event_type")
