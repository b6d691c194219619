"""What Spark is asked to do: scans, pushed filters, read columns, joins."""

import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from tablewright.operators import charts, cleaning, filters, profile
from tablewright.operators.modeling import hash_split
from tablewright.operators.sqltext import sql_select
from tests.conftest import SF


@pytest.fixture(scope="module")
def orders(spark):
    return spark.read.parquet(f"{SF}/orders.parquet")


@pytest.fixture(scope="module")
def lines(spark):
    return spark.read.parquet(f"{SF}/lineitem.parquet")


def plan(df, capsys):
    capsys.readouterr()
    df.explain("formatted")
    return capsys.readouterr().out


def scans(text):
    return len(re.findall(r"^\(\d+\) Scan parquet", text, re.MULTILINE))


def read_columns(text):
    return {c.split(":")[0] for found in re.findall(r"ReadSchema: struct<(.*?)>\n", text) for c in found.split(",")}


def test_filter_chain_is_one_pushed_filter(orders, capsys):
    kept = filters.apply_filters(
        orders,
        [
            filters.DateRange("o_orderdate", date(1996, 1, 1), date(1996, 12, 31)),
            filters.NumericRange("o_totalprice", 1.0, 100.0),
            filters.OneOf("o_orderstatus", ["F"]),
        ],
    )
    text = plan(charts.bar(kept, "o_orderpriority", "o_totalprice"), capsys)
    assert scans(text) == 1 and len(re.findall(r"^\(\d+\) Filter", text, re.MULTILINE)) == 1
    pushed = re.search(r"PushedFilters: (.*)", text).group(1)
    for part in ("GreaterThanOrEqual(o_orderdate", "LessThan(o_orderdate", "LessThanOrEqual(o_totalprice", "o_orderstatus"):
        assert part in pushed
    assert read_columns(text) == {"o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"}


def test_filters_push_through_sql_text(orders, capsys):
    picked = sql_select(orders, "SELECT o_orderkey, o_orderstatus FROM df WHERE o_custkey > 10")
    text = plan(filters.one_of(picked, "o_orderstatus", ["F"]), capsys)
    pushed = re.search(r"PushedFilters: (.*)", text).group(1)
    assert "GreaterThan(o_custkey,10)" in pushed and "EqualTo(o_orderstatus,F)" in pushed
    assert read_columns(text) == {"o_orderkey", "o_custkey", "o_orderstatus"}


def test_filter_summary_is_one_scan(orders, capsys):
    assert scans(plan(filters.filter_summary(orders, [filters.NumericRange("o_totalprice", 1.0, 2.0)]), capsys)) == 1


@pytest.mark.parametrize(
    "report",
    [
        cleaning.missing_summary,
        profile.correlation_matrix,
        profile.missing_patterns,
        lambda df: profile.key_figures(df, mean_of="l_tax", sum_of="l_tax", unique_of="l_returnflag"),
        lambda df: charts.radar(df, ["l_tax", "l_quantity", "l_discount"], "l_returnflag"),
        cleaning.duplicate_groups,
        cleaning.duplicate_rows,
    ],
)
def test_all_columns_come_from_one_scan(lines, capsys, report):
    text = plan(report(lines), capsys)
    assert scans(text) == 1 and "Join" not in text and "CartesianProduct" not in text


def test_correlation_reads_numbers_only(lines, capsys):
    text = plan(profile.correlation_matrix(lines, ["l_tax", "l_quantity"]), capsys)
    assert read_columns(text) == {"l_tax", "l_quantity"}


def test_charts_read_their_columns_and_count_before_the_shuffle(lines, capsys):
    for chart, wanted in (
        (charts.histogram(lines, "l_tax", "l_returnflag"), {"l_tax", "l_returnflag"}),
        (charts.density_heatmap(lines, "l_tax", "l_quantity"), {"l_tax", "l_quantity"}),
        (charts.ols_trend(lines, "l_tax", "l_quantity", "l_returnflag"), {"l_tax", "l_quantity", "l_returnflag"}),
    ):
        text = plan(chart, capsys)
        assert read_columns(text) == wanted and scans(text) == 1
        tree = text.split("(1) Scan")[0]
        assert tree.index("Exchange") < tree.rindex("HashAggregate")  # the tree lists the shuffle above


def test_preview_is_a_top_k(orders, capsys):
    from tablewright.operators.columns import preview

    text = plan(preview(orders, ["o_orderkey"]), capsys)
    assert "TakeOrderedAndProject" in text and "Exchange rangepartitioning" not in text


def test_box_joins_by_broadcast_without_shuffling_the_rows(spark, capsys):
    events = spark.read.parquet(f"{SF}/events.parquet")
    text = plan(charts.box_outliers(events, "value", "event_type"), capsys)
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text and scans(text) == 1


def test_split_needs_no_shuffle(orders, capsys):
    for part in hash_split(orders, ["o_orderkey"]):
        assert "Exchange" not in plan(part, capsys)


def test_one_hot_and_scale_are_projections(orders, capsys):
    from tablewright.operators import features

    assert "Exchange" not in plan(features.one_hot(orders, ["o_orderstatus"]), capsys)
    assert "Exchange" not in plan(features.scale(orders, ["o_totalprice"])[0], capsys)
    assert "Exchange" not in plan(features.log_transform(orders, ["o_totalprice"]), capsys)


def test_label_encoding_broadcasts_the_classes(orders, capsys):
    from tablewright.operators import features

    text = plan(features.label_encode(orders, ["o_orderpriority"])[0], capsys)
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text and scans(text) == 1


def test_long_value_list_is_a_predicate_like_a_short_one(orders, capsys):
    kept = filters.one_of(orders, "o_custkey", list(range(5000)))
    assert kept.columns == orders.columns
    text = plan(kept, capsys)
    assert "Join" not in text and "Exchange" not in text and scans(text) == 1


def test_ranges_push_through_sql_text_of_tables_without_nan(orders, capsys):
    kept = filters.apply_filters(
        orders, [filters.NumericRange("o_totalprice", 1.0, 9.0)], sql="SELECT * FROM df;", nan_as_null=False
    )
    pushed = re.search(r"PushedFilters: (.*)", plan(kept, capsys)).group(1)
    assert "GreaterThanOrEqual(o_totalprice,1.0)" in pushed and "LessThanOrEqual(o_totalprice,9.0)" in pushed


def test_the_registered_chain_pushes_both_ends(spark, capsys):
    from tablewright import plans

    pushed = re.search(r"PushedFilters: (.*)", plan(plans.queries()["f8_filter_chain"](spark, SF), capsys)).group(1)
    assert "GreaterThanOrEqual(o_totalprice,50000.0)" in pushed and "LessThanOrEqual(o_totalprice,400000.0)" in pushed


def test_violin_joins_groups_not_rows(lines, capsys):
    text = plan(charts.violin_stats(lines, "l_returnflag", "l_quantity"), capsys)
    tree = text.split("(1) Scan")[0]
    assert tree.index("Join") < tree.index("HashAggregate")  # every scan is aggregated below the join


def test_pie_uses_one_counted_table(orders, capsys):
    text = plan(charts.pie(orders, "o_orderstatus"), capsys)
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def test_quantile_ranges_reach_parquet(lines, capsys):
    from tablewright.functions import quantiles

    narrow = lines.select("l_quantity", "l_extendedprice")
    wanted = [quantiles._Range("l_quantity", 1.0, 2.0, 0, 9), quantiles._Range("l_extendedprice", None, 5.0, 0, 9)]
    pushed = re.search(r"PushedFilters: (.*)", plan(quantiles._rows_in(narrow, wanted), capsys)).group(1)
    assert "GreaterThan(l_quantity,1.0)" in pushed and "LessThan(l_extendedprice,5.0)" in pushed


def test_sampling_never_decides(spark):
    """Exact quantiles although the pivots come from a sample."""
    from tablewright.functions import quantiles

    df = spark.range(200_000).select((F.hash("id") % 1000).cast("double").alias("x"))
    got = quantiles.column_quantiles(df, ["x"], [0.25, 0.5, 0.9])["x"]
    assert got == df.agg(F.percentile("x", [0.25, 0.5, 0.9])).first()[0]


def test_wide_correlations_sum_all_pairs_in_one_scan(spark, monkeypatch):
    """Gaps in each of 60 columns: equal to pandas, and one matrix for all pairs."""
    import numpy as np

    looks = []
    inner = profile._matrix_pairs
    monkeypatch.setattr(profile, "_matrix_pairs", lambda vectors, names: looks.append(len(names)) or inner(vectors, names))
    columns = [F.when(F.col("id") % (i + 2) != 0, F.hash(F.col("id") + i) % 1000 + F.col("id") * i) for i in range(60)]
    df = spark.range(300).select(*[c.cast("double").alias(f"c{i}") for i, c in enumerate(columns)], F.lit(1.0).alias("flat"))
    got = profile.correlation_matrix(df).toPandas().pivot(index="col_a", columns="col_b", values="corr").astype(float)
    expected = df.toPandas().corr()
    assert looks == [60]
    np.testing.assert_allclose(got.loc[expected.index, expected.columns], expected, atol=1e-9)
