"""Queries on the data behind charts."""

from pyspark.sql import functions as F

from tablewright.operators import charts as ops
from tablewright.plans.registry import GAPS_SQL, line_numbers, orders_with_gaps, query, table


def _rounded(df, digits, *columns):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _bin_sql(column, lo="lo", hi="hi"):
    return f"CAST(least(floor(({column} - {lo}) / (({hi} - {lo}) / 30)), 29) AS BIGINT)"


@query(
    "v1_histogram",
    f"""
    WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
    SELECT bin, round(lo + bin * ((hi - lo) / 30), 6) AS bin_start,
           round(lo + (bin + 1) * ((hi - lo) / 30), 6) AS bin_end, "count" FROM (
      SELECT {_bin_sql("l_extendedprice")} AS bin, lo, hi, count(*) AS "count"
      FROM lineitem, b GROUP BY 1, 2, 3)
    """,
)
def histogram(spark, sf):
    return _rounded(ops.histogram(table(spark, sf, "lineitem"), "l_extendedprice"), 6, "bin_start", "bin_end")


@query(
    "v1_histogram_color",
    GAPS_SQL
    + f""", b AS (SELECT min(price) AS lo, max(price) AS hi FROM gaps)
    SELECT status, {_bin_sql("price")} AS bin, count(*) AS "count"
    FROM gaps, b WHERE price IS NOT NULL GROUP BY 1, 2
    """,
)
def histogram_color(spark, sf):
    return ops.histogram(orders_with_gaps(spark, sf), "price", color="status").select("status", "bin", "count")


@query("v1_rug", GAPS_SQL + "SELECT status, price FROM gaps WHERE price IS NOT NULL")
def rug(spark, sf):
    return ops.rug(orders_with_gaps(spark, sf), "price", color="status")


_BOX_SQL = """
WITH q AS (
  SELECT event_type, count(value) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
         quantile_cont(value, 0.75) AS q3 FROM events GROUP BY event_type),
v AS (
  SELECT e.event_type, e.value, q.n, q.q1, q.median, q.q3,
         e.value BETWEEN q.q1 - 1.5 * (q.q3 - q.q1) AND q.q3 + 1.5 * (q.q3 - q.q1) AS inside
  FROM events e JOIN q ON e.event_type = q.event_type)
"""


@query(
    "v2_boxplot",
    _BOX_SQL
    + """
    SELECT event_type, n, min(value) AS min, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3,
           max(value) AS max, min(value) FILTER (WHERE inside) AS lower_whisker,
           max(value) FILTER (WHERE inside) AS upper_whisker, count(*) FILTER (WHERE NOT inside) AS outliers
    FROM v GROUP BY event_type, n, q1, median, q3
    """,
)
def boxplot(spark, sf):
    return _rounded(ops.box_stats(table(spark, sf, "events"), "value", "event_type"), 4, "q1", "median", "q3")


@query(
    "v2_boxplot_single",
    GAPS_SQL
    + """, q AS (
      SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.5) AS median, quantile_cont(price, 0.75) AS q3
      FROM gaps)
    SELECT count(price) AS n, min(price) AS min, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3,
           max(price) AS max,
           min(price) FILTER (WHERE price >= q1 - 1.5 * (q3 - q1)) AS lower_whisker,
           max(price) FILTER (WHERE price <= q3 + 1.5 * (q3 - q1)) AS upper_whisker,
           count(*) FILTER (WHERE price < q1 - 1.5 * (q3 - q1) OR price > q3 + 1.5 * (q3 - q1)) AS outliers
    FROM gaps, q GROUP BY q.q1, q.median, q.q3
    """,
)
def boxplot_single(spark, sf):
    return _rounded(ops.box_stats(orders_with_gaps(spark, sf), "price"), 4, "q1", "median", "q3")


@query("v2_box_outliers", _BOX_SQL + "SELECT event_type, value FROM v WHERE NOT inside")
def box_outliers(spark, sf):
    return ops.box_outliers(table(spark, sf, "events"), "value", "event_type")


@query("v2_box_points", "SELECT value FROM events")
def box_points(spark, sf):
    return ops.box_points(table(spark, sf, "events"), "value")


@query(
    "v3_scatter_ols",
    """
    SELECT l_returnflag, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
           round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
           round(regr_r2(l_extendedprice, l_quantity), 6) AS r2
    FROM lineitem GROUP BY l_returnflag
    """,
)
def scatter_ols(spark, sf):
    found = ops.ols_trend(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag")
    return _rounded(_rounded(found, 4, "slope", "intercept"), 6, "r2")


@query(
    "v3_scatter_points",
    GAPS_SQL + "SELECT customer, price, status FROM gaps WHERE customer IS NOT NULL AND price IS NOT NULL",
)
def scatter_points(spark, sf):
    return ops.scatter_points(orders_with_gaps(spark, sf), "customer", "price", "status")


@query("v4_pair_points", "SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def pair_points(spark, sf):
    return ops.pair_points(line_numbers(spark, sf))


@query(
    "v5_pie",
    GAPS_SQL
    + """
    SELECT status, count(*) AS "count", round(count(*) * 1.0 / (SELECT count(status) FROM gaps), 6) AS share
    FROM gaps WHERE status IS NOT NULL GROUP BY status
    """,
)
def pie(spark, sf):
    return _rounded(ops.pie(orders_with_gaps(spark, sf), "status"), 6, "share")


def _bar_query(aggregation, sql):
    @query(
        f"v6_bar_{aggregation}",
        GAPS_SQL + f"SELECT status, {sql} AS height FROM gaps WHERE status IS NOT NULL GROUP BY status",
    )
    def run(spark, sf):
        heights = ops.bar(orders_with_gaps(spark, sf), "status", "price", aggregation)
        return heights if aggregation == "count" else _rounded(heights, 2, "height")


_bar_query("sum", "round(coalesce(sum(price), 0), 2)")
_bar_query("mean", "round(avg(price), 2)")
_bar_query("count", "count(price)")


@query(
    "v6_bar_color",
    """
    SELECT l_returnflag, l_linestatus, sum(l_quantity) AS height FROM lineitem GROUP BY l_returnflag, l_linestatus
    """,
)
def bar_color(spark, sf):
    return ops.bar(table(spark, sf, "lineitem"), "l_returnflag", "l_quantity", color="l_linestatus")


@query("v7_line", "SELECT event_type, event_id, value FROM events ORDER BY event_type, event_id, value")
def line(spark, sf):
    return ops.line(table(spark, sf, "events"), "event_id", "value", "event_type")


@query(
    "v7_line_buckets",
    """
    SELECT strftime(ts, '%Y-%m-%d') AS event_day, event_type, round(avg(value), 6) AS height
    FROM events GROUP BY 1, 2
    """,
)
def line_buckets(spark, sf):
    points = ops.line_buckets(table(spark, sf, "events"), "ts", "value", "day", color="event_type")
    return points.select(F.date_format("ts", "yyyy-MM-dd").alias("event_day"), "event_type", F.round("height", 6).alias("height"))


@query(
    "v8_area_stacked",
    """
    SELECT event_day, event_type, round(height, 2) AS height, round(stack_high - height, 2) AS stack_low,
           round(stack_high, 2) AS stack_high FROM (
      SELECT *, sum(height) OVER (PARTITION BY event_day ORDER BY event_type ROWS UNBOUNDED PRECEDING) AS stack_high
      FROM (SELECT strftime(ts, '%Y-%m-%d') AS event_day, event_type, sum(value) AS height
            FROM events GROUP BY 1, 2))
    """,
)
def area_stacked(spark, sf):
    days = table(spark, sf, "events").withColumn("event_day", F.date_format("ts", "yyyy-MM-dd"))
    return _rounded(ops.area(days, "event_day", "value", "event_type"), 2, "height", "stack_low", "stack_high")


_VIOLIN_SQL = """
WITH s AS (
  SELECT event_type, count(value) AS n, min(value) AS min, quantile_cont(value, 0.25) AS q1,
         quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3, max(value) AS max,
         avg(value) AS mean, stddev_samp(value) AS std FROM events GROUP BY event_type),
w AS (
  SELECT *, greatest(1.059 * least(std, (q3 - q1) / 1.349) * pow(n, -0.2), (max - min) / 100) AS bandwidth FROM s)
"""


@query(
    "v9_violin_stats",
    _VIOLIN_SQL
    + """
    SELECT event_type, n, min, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, max,
           round(mean, 6) AS mean, round(std, 6) AS std, round(bandwidth, 6) AS bandwidth FROM w
    """,
)
def violin_stats(spark, sf):
    found = ops.violin_stats(table(spark, sf, "events"), "event_type", "value")
    return _rounded(_rounded(found, 4, "q1", "median", "q3"), 6, "mean", "std", "bandwidth")


@query(
    "v9_violin_density",
    _VIOLIN_SQL
    + """, bins AS (
      SELECT e.event_type, w.min + (least(floor((e.value - w.min) / ((w.max - w.min) / 512)), 511) + 0.5)
               * ((w.max - w.min) / 512) AS center, count(*) AS in_bin
      FROM events e JOIN w ON e.event_type = w.event_type GROUP BY 1, 2),
    grid AS (
      SELECT w.*, CAST(i AS INTEGER) AS point,
             (min - 2 * bandwidth) + i * ((max - min + 4 * bandwidth) / 99) AS position
      FROM w, range(100) AS r(i))
    SELECT g.event_type, g.point, round(g.position, 6) AS position,
           round(sum(b.in_bin * exp(-0.5 * pow((g.position - b.center) / g.bandwidth, 2)))
                 / sqrt(2 * pi()) / (any_value(g.n) * any_value(g.bandwidth)), 8) AS density
    FROM grid g JOIN bins b ON g.event_type = b.event_type GROUP BY g.event_type, g.point, g.position
    """,
)
def violin_density(spark, sf):
    found = ops.violin_density(table(spark, sf, "events"), "event_type", "value")
    return _rounded(_rounded(found, 6, "position"), 8, "density")


@query(
    "v10_density",
    f"""
    WITH b AS (SELECT min(l_quantity) AS xlo, max(l_quantity) AS xhi, min(l_extendedprice) AS ylo,
                      max(l_extendedprice) AS yhi FROM lineitem)
    SELECT x_bin, y_bin, round(xlo + x_bin * ((xhi - xlo) / 30), 6) AS x_start,
           round(ylo + y_bin * ((yhi - ylo) / 30), 6) AS y_start, "count" FROM (
      SELECT {_bin_sql("l_quantity", "xlo", "xhi")} AS x_bin, {_bin_sql("l_extendedprice", "ylo", "yhi")} AS y_bin,
             xlo, xhi, ylo, yhi, count(*) AS "count"
      FROM lineitem, b GROUP BY 1, 2, 3, 4, 5, 6)
    """,
)
def density(spark, sf):
    found = ops.density_heatmap(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return _rounded(found, 6, "x_start", "y_start")


@query(
    "v11_radar",
    " UNION ALL ".join(
        f"SELECT l_returnflag AS name, '{c}' AS axis, round(avg({c}), 4) AS value FROM lineitem GROUP BY l_returnflag"
        for c in ("l_quantity", "l_discount", "l_tax")
    ),
)
def radar(spark, sf):
    found = ops.radar(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_returnflag")
    return _rounded(found, 4, "value")


@query(
    "v11_radar_sum",
    GAPS_SQL
    + """
    SELECT status AS name, 'price' AS axis, round(coalesce(sum(price), 0), 2) AS value
    FROM gaps WHERE status IS NOT NULL GROUP BY status
    """,
)
def radar_sum(spark, sf):
    return _rounded(ops.radar(orders_with_gaps(spark, sf), ["price"], "status", "sum"), 2, "value")


@query(
    "v11_radar_first_row",
    """
    WITH first_row AS (SELECT * FROM part ORDER BY p_partkey LIMIT 1)
    SELECT 'Values' AS name, 'p_size' AS axis, CAST(p_size AS DOUBLE) AS value FROM first_row
    UNION ALL SELECT 'Values', 'p_retailprice', p_retailprice FROM first_row
    """,
)
def radar_first_row(spark, sf):
    return ops.radar(table(spark, sf, "part"), ["p_size", "p_retailprice"], order_by=["p_partkey"])
