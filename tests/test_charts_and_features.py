import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.operators import charts, cleaning, features
from tests.conftest import SF, rows


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(i),) for i in range(31)] + [(None,), (float("nan"),)], "x double")
    got = {r["bin"]: r["count"] for r in charts.histogram(df, "x").collect()}
    assert sum(got.values()) == 31 and got[29] == 2 and got[0] == 1
    same = charts.histogram(spark.createDataFrame([(2.0,), (2.0,)], "x double"), "x").collect()
    assert [(r["bin"], r["bin_start"], r["bin_end"], r["count"]) for r in same] == [(0, 2.0, 2.0, 2)]
    assert charts.histogram(df.limit(0), "x").count() == 0


def test_box_of_one_group_and_nothing(quirks):
    row = charts.box_stats(quirks, "x").first()
    assert (row["n"], row["min"], row["median"], row["max"]) == (3, 1.0, 4.0, 100.0)
    assert charts.box_stats(quirks, "empty").count() == 0
    assert charts.box_stats(quirks.limit(0), "x").count() == 0
    by = {r["k"]: r["n"] for r in charts.box_stats(quirks, "x", "k").collect()}
    assert by == {"a": 1, "b": 1}


def test_box_points(quirks):
    assert sorted(r["value"] for r in charts.box_points(quirks, "x").collect()) == [1.0, 4.0, 100.0]


def test_trend_of_awkward_groups(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 3.0), ("a", 2.0, 5.0), ("a", None, 9.0), ("b", 1.0, 1.0), ("b", 1.0, 2.0), ("c", 1.0, 4.0), ("c", 2.0, 4.0)],
        "g string, x double, y double",
    )
    got = {r["g"]: tuple(r)[1:] for r in charts.ols_trend(df, "x", "y", "g").collect()}
    assert got["a"] == pytest.approx((2, 2.0, 1.0, 1.0))
    assert got["b"] == (2, None, None, None)
    assert got["c"] == (2, 0.0, 4.0, 1.0)


def test_bar_quirks(spark, quirks):
    empty = {r["k"]: r["height"] for r in charts.bar(quirks, "k", "empty").collect()}
    assert empty == {"a": 0.0, "b": 0.0}
    assert {r["k"]: r["height"] for r in charts.bar(quirks, "k", "empty", "mean").collect()} == {"a": None, "b": None}
    assert {r["k"]: r["height"] for r in charts.bar(quirks, "k", "x", "count").collect()} == {"a": 1, "b": 1}
    assert charts.bar(quirks, "k", "x", "anything").collect() == charts.bar(quirks, "k", "x", "sum").collect()


def test_pie_and_radar(quirks):
    assert rows(charts.pie(quirks, "k")) == [("a", 2, 0.5), ("b", 2, 0.5)]
    first = charts.radar(quirks, ["x", "constant"], order_by=["id"])
    assert rows(first) == [("Values", "constant", 5.0), ("Values", "x", 1.0)]
    with pytest.raises(ValueError):
        charts.radar(quirks, ["x"])


def test_area_without_colour(quirks):
    assert rows(charts.area(quirks, "k", "constant"))[0] == ("a", 10.0, 0.0, 10.0)


def test_violin_density_integrates_to_one(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    pdf = charts.violin_density(events, "event_type", "value").toPandas().sort_values("point")
    for _, group in pdf.groupby("event_type"):
        assert np.trapezoid(group["density"], group["position"]) == pytest.approx(1.0, abs=0.05)
    flat = spark.createDataFrame([("a", 1.0), ("a", 1.0)], "g string, v double")
    assert all(r["density"] is None for r in charts.violin_density(flat, "g", "v").collect())


def test_heatmap_counts_all(quirks):
    assert charts.density_heatmap(quirks, "x", "constant").agg(F.sum("count")).first()[0] == 3


def test_scale(quirks):
    scaled, fitted = features.scale(quirks, ["x", "constant", "empty"])
    got = [r["x"] for r in scaled.orderBy("id").collect()]
    values = np.array([1.0, 4.0, 100.0])
    expected = (values - values.mean()) / values.std()
    assert got[1] is None and got[2] is None
    np.testing.assert_allclose([got[0], got[3], got[4]], expected)
    assert {r["constant"] for r in scaled.collect()} == {0.0} and {r["empty"] for r in scaled.collect()} == {None}
    again = features.apply_scale(quirks, fitted)
    assert [r["x"] for r in again.orderBy("id").collect()] == got
    small, _ = features.scale(quirks, ["x", "constant"], "minmax")
    assert [r["x"] for r in small.orderBy("id").collect()] == [0.0, None, None, pytest.approx(3 / 99), 1.0]
    assert {r["constant"] for r in small.collect()} == {0.0}
    assert features.scale(quirks, [])[0] is quirks
    with pytest.raises(ValueError):
        features.scale(quirks, ["x"], "robust")


def test_log_shift(spark):
    df = spark.createDataFrame([(-1.0, 0.5), (3.0, -0.5), (None, 2.0)], "a double, b double")
    got = features.log_transform(df, ["a", "b"]).collect()
    np.testing.assert_allclose([got[0]["a"], got[1]["a"]], np.log1p([1.0, 5.0]))
    np.testing.assert_allclose([r["b"] for r in got], np.log1p([0.5, -0.5, 2.0]))
    assert got[2]["a"] is None


def test_one_hot(spark, quirks):
    got = features.one_hot(quirks.select("id", "k", "b"), ["k", "b"])
    assert got.columns == ["id", "k_a", "k_b", "b_False", "b_True"]
    assert tuple(got.where("id = 5").first()) == (5, False, False, False, True)
    numbers = spark.createDataFrame([(10,), (9,), (None,)], "n int")
    assert features.one_hot(numbers, ["n"]).columns == ["n_9", "n_10"]
    assert features.one_hot(numbers, ["n"], drop_first=True).columns == ["n_10"]
    with pytest.raises(ValueError):
        features.one_hot(spark.range(20), ["id"], limit=10)
    with pytest.raises(ValueError):
        features.encode_categorical(quirks, ["k"], "hash")


@pytest.mark.parametrize("limit", [None, 0])
def test_one_hot_vector(quirks, limit):
    got = features.one_hot_vector(quirks.select("id", "k", "b"), ["k", "b"], limit).orderBy("id").collect()
    assert [r["k_onehot"].toArray().tolist() for r in got] == [[1, 0], [1, 0], [0, 1], [0, 1], [0, 0]]
    assert [r["b_onehot"].toArray().tolist() for r in got] == [[0, 1], [1, 0], [0, 0], [0, 1], [0, 1]]


def test_label_gives_missing_its_own_class(quirks):
    encoded, classes = features.label_encode(quirks, ["k"])
    assert [r["k"] for r in encoded.orderBy("id").collect()] == [1, 1, 2, 2, 0]
    assert encoded.columns == quirks.columns
    assert rows(classes["k"]) == [("None", 0), ("a", 1), ("b", 2)]


def test_correlated_features(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=300)
    pdf = pd.DataFrame({"y": x, "near": x + 0.1 * rng.normal(size=300), "mirror": -x, "far": rng.normal(size=300), "flat": 1.0})
    assert features.correlated_features(spark.createDataFrame(pdf), "y") == ["near", "mirror"]


_RESERVED = {
    "count": [lambda d, c: charts.pie(d, c), lambda d, c: charts.histogram(d, "y", c)],
    "height": [lambda d, c: charts.bar(d, c, "y"), lambda d, c: charts.area(d, c, "y")],
    "n": [lambda d, c: charts.box_stats(d, "y", c), lambda d, c: charts.violin_stats(d, c, "y"), lambda d, c: charts.ols_trend(d, "y", "y", c)],
    "copies": [lambda d, c: cleaning.duplicate_groups(d)],
}


@pytest.mark.parametrize("name", list(_RESERVED))
def test_names_of_results_are_not_given_twice(spark, name):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], f"{name} string, y double")
    for chart in _RESERVED[name]:
        with pytest.raises(ValueError):
            chart(df, name)


@pytest.mark.parametrize("name", ["value", "copies", "portion", "member", "bin_", "column_"])
def test_work_columns_do_not_meet_those_of_the_table(spark, name):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 2.0)], f"{name} string, y double")
    assert cleaning.duplicate_rows(df).count() == 2 and cleaning.duplicate_count(df).first()[0] == 2
    assert charts.box_stats(df, "y", name).count() == 2 and charts.violin_stats(df, name, "y").count() == 2
    assert charts.violin_density(df, name, "y").select(name).distinct().count() == 2


def test_nan_is_no_group(spark):
    df = spark.createDataFrame([(1.0, 1.0), (float("nan"), 2.0), (None, 3.0)], "g double, y double")
    assert charts.box_stats(df, "y", "g").count() == 1 and charts.bar(df, "g", "y").count() == 1
