from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.operators import forecast as series
from tablewright.operators import metrics, modeling
from tablewright.operators.features import category_levels


@pytest.fixture(scope="module")
def houses(spark):
    rng = np.random.default_rng(3)
    n = 600
    pdf = pd.DataFrame({"id": np.arange(n), "size": rng.uniform(20, 200, n), "kind": rng.choice(["flat", "house", "loft"], n)})
    pdf["sold"] = pd.Timestamp("2020-01-01") + pd.to_timedelta(rng.integers(0, 900, n), unit="D")
    pdf["price"] = 3 * pdf["size"] + pdf["kind"].map({"flat": 0, "house": 50, "loft": 90}) + rng.normal(0, 2, n)
    pdf["big"] = np.where(pdf["size"] > 110, "yes", "no")
    pdf["band"] = pd.cut(pdf["size"], [0, 80, 140, 300], labels=["s", "m", "l"]).astype(str)
    pdf.loc[::25, "size"] = np.nan
    df = spark.createDataFrame(pdf)
    return df.withColumn("kind", F.when(F.col("id") % 40 != 0, F.col("kind")))


def test_problem_type(houses, spark):
    assert modeling.problem_type(houses, "price") == "regression"
    assert modeling.problem_type(houses, "kind") == "classification"
    ten = spark.range(1000).select((F.col("id") % 10).alias("t"), (F.col("id") % 11).alias("e"))
    assert modeling.problem_type(ten, "t") == "classification" and modeling.problem_type(ten, "e") == "regression"


def test_problem_type_beyond_the_first_rows(spark, monkeypatch):
    monkeypatch.setattr(modeling, "_FIRST_LOOK", 5)
    assert modeling.problem_type(spark.range(100), "id") == "regression"


def test_linear_regression(houses):
    data = houses.where("id % 25 <> 0")
    model = modeling.train(data, "price", "Linear Regression", features=["size", "kind"], split_keys=["id"])
    assert model.metrics["r2"] > 0.99
    assert sorted(model.features) == ["kind_house", "kind_loft", "size"]
    top = {r["feature"]: r["importance"] for r in modeling.feature_importance(model).collect()}
    assert top["size"] == pytest.approx(3, abs=0.05) and top["kind_loft"] == pytest.approx(90, abs=5)
    # Prices of unknown and missing kinds are those of the first kind.
    rows = data.limit(3).withColumn("kind", F.lit("castle"))
    assert model.score(rows).where("prediction IS NULL").count() == 0


def test_dates_and_gaps_are_usable_features(houses):
    model = modeling.train(houses, "price", "Random Forest", rounds=5, split_keys=["id"])
    assert {"id", "size", "sold"} <= set(model.features) and model.metrics["r2"] > 0.5


@pytest.mark.parametrize("algorithm", ["Logistic Regression", "Random Forest", "XGBoost"])
@pytest.mark.parametrize("target", ["big", "band"])
def test_classifiers(houses, algorithm, target):
    data = houses.where("id % 25 <> 0").select("id", "size", "kind", target)
    model = modeling.train(data, target, algorithm, features=["size", "kind"], split_keys=["id"], rounds=5)
    assert model.metrics["accuracy"] > 0.85
    assert set(model.metrics) == {"accuracy", "f1", "precision", "recall"}
    scored = model.score(data.drop(target))
    assert {r[0] for r in scored.select("prediction").distinct().collect()} <= {"yes", "no", "s", "m", "l"}
    best = modeling.feature_importance(model).first()
    assert best["feature"] == "size" or algorithm == "Logistic Regression"


def test_boosted_regression(houses):
    model = modeling.train(houses.where("id % 25 <> 0"), "price", "XGBoost", rounds=40, features=["size", "kind"], split_keys=["id"])
    assert model.metrics["r2"] > 0.9


def test_numeric_classes_keep_their_type(spark):
    df = spark.range(300).select("id", (F.col("id") % 2).cast("int").alias("y"), ((F.col("id") % 2) * 5.0 + F.rand(1)).alias("x"))
    model = modeling.train(df, "y", "Logistic Regression", features=["x"], split_keys=["id"])
    assert model.score(df).schema["prediction"].dataType.simpleString() == "int" and model.metrics["accuracy"] == 1.0


def test_wrong_combinations(houses):
    with pytest.raises(ValueError):
        modeling.train(houses, "kind", "Linear Regression")
    with pytest.raises(ValueError):
        modeling.train(houses, "price", "Logistic Regression")
    with pytest.raises(ValueError):
        modeling.train(houses, "price", "Perceptron")


def test_save_load_and_defaults(houses, tmp_path):
    model = modeling.train(houses, "price", "Linear Regression", features=["size", "kind"], split_keys=["id"])
    model.save(str(tmp_path / "model"))
    back = modeling.TrainedModel.load(str(tmp_path / "model"))
    assert back.metrics == model.metrics and back.features == model.features
    some = houses.select("id", "size", "kind").where("id < 20")
    one, two = (m.score(some).orderBy("id").collect() for m in (model, back))
    assert [r["prediction"] for r in one] == pytest.approx([r["prediction"] for r in two])
    values = modeling.default_values(houses, ["size", "kind"])
    filled = model.score(some.select("id"), values)
    assert filled.select("prediction").distinct().count() == 1
    assert values["kind"] in ("flat", "house", "loft")


def test_split_is_stable(houses):
    first, test = modeling.hash_split(houses, ["id"], 0.3)
    moved, moved_test = modeling.hash_split(houses.repartition(7), ["id"], 0.3)
    assert {r["id"] for r in test.collect()} == {r["id"] for r in moved_test.collect()}
    assert first.count() + test.count() == 600 and first.join(test, "id").count() == 0
    assert 0.2 < test.count() / 600 < 0.4
    with pytest.raises(ValueError):
        modeling.hash_split(houses, ["id"], 1.0)


def test_design_matrix_equals_pandas(houses):
    pdf = houses.select("id", "size", "kind", "price").toPandas()
    wide = pd.get_dummies(pdf.drop(columns="price"), drop_first=True).astype(float)
    wide = wide.fillna(wide.mean())
    got = modeling.design_matrix(houses.select("id", "size", "kind", "price"), "price").toPandas().sort_values("id")
    np.testing.assert_allclose(got[wide.columns].to_numpy(), wide.to_numpy())


def test_metrics_on_awkward_tables(spark):
    never = spark.createDataFrame([("a", "b"), ("b", "b"), ("c", "b"), (None, "b")], "t string, p string")
    row = metrics.classification_metrics(never, "t", "p").first()
    assert row["accuracy"] == pytest.approx(1 / 3) and row["precision"] == pytest.approx(1 / 9)
    assert row["f1"] == pytest.approx(0.5 / 3)
    exact = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "t double, p double")
    assert tuple(metrics.regression_metrics(exact, "t", "p").first()) == (0.0, 1.0)
    off = spark.createDataFrame([(1.0, 2.0), (1.0, 2.0)], "t double, p double")
    assert tuple(metrics.regression_metrics(off, "t", "p").first()) == (1.0, 0.0)


def _days(spark, n, value):
    start = date(2021, 1, 1)
    return spark.createDataFrame([(start + timedelta(days=i), float(value(i))) for i in range(n)], "day date, v double")


def test_forecast_continues_trend_and_week(spark):
    df = _days(spark, 200, lambda i: 100 + 0.5 * i + 10 * (i % 7 == 0))
    got = series.forecast(df, "day", "v", 14).toPandas().sort_values("ds").reset_index(drop=True)
    assert len(got) == 214 and (got["yhat_lower"] < got["yhat"]).all() and (got["yhat"] < got["yhat_upper"]).all()
    truth = np.array([100 + 0.5 * i + 10 * (i % 7 == 0) for i in range(200, 214)])
    assert np.abs(got["yhat"].to_numpy()[200:] - truth).max() < 4
    assert got["ds"].iloc[-1] == date(2021, 1, 1) + timedelta(days=213)


def test_forecast_follows_a_change_of_trend(spark):
    df = _days(spark, 300, lambda i: i if i < 150 else 150 - (i - 150))
    got = series.forecast(df, "day", "v", 10).toPandas().sort_values("ds")
    assert np.abs(got["yhat"].to_numpy()[-10:] - np.arange(0, -10, -1)).max() < 12


def test_forecast_of_short_and_many_series(spark):
    df = _days(spark, 40, lambda i: i).withColumn("g", F.lit("a")).unionByName(
        _days(spark, 1, lambda i: 7).withColumn("g", F.lit("b"))
    )
    got = series.forecast(df, "day", "v", 5, by=["g"]).toPandas()
    assert got.groupby("g").size().to_dict() == {"a": 45, "b": 6}
    assert got["yhat"].notna().all()
    gaps = df.union(spark.createDataFrame([(None, 1.0, "a"), (date(2021, 1, 1), None, "a")], df.schema))
    assert series.forecast(gaps, "day", "v", 5, by=["g"]).count() == 51
    with pytest.raises(ValueError):
        series.forecast(df, "day", "v", 0)
    with pytest.raises(ValueError):
        series.forecast(df, "day", "v", 366)


def test_forecast_interval_covers_the_single_rows(spark):
    days = spark.range(60).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("day"))
    rows = days.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(100)))).select("day", (100 + 10 * F.randn(5)).alias("v"))
    got = series.forecast(rows, "day", "v", 1).toPandas()
    half = ((got["yhat_upper"] - got["yhat_lower"]) / 2).iloc[:60].mean()
    assert half == pytest.approx(1.2816 * 10, rel=0.05)


def test_tree_shape_is_an_argument(houses, tmp_path):
    data = houses.where("id % 25 <> 0").select("size", "price")
    deep = modeling.fit(data, "price", "Random Forest", rounds=3, trees={"max_depth": 8})
    assert deep.trees["max_depth"] == 8 and deep.pipeline.stages[-1].trees[0].depth > 5
    deep.save(str(tmp_path / "deep"))
    assert modeling.TrainedModel.load(str(tmp_path / "deep")).trees == deep.trees
    with pytest.raises(ValueError):
        modeling.fit(data, "price", "Random Forest", trees={"depth": 8})


def test_boolean_gaps_are_filled(spark):
    df = spark.createDataFrame([(True, 1.0), (None, 2.0), (False, 3.0)], "flag boolean, y double")
    assert [r["flag"] for r in modeling.design_matrix(df, "y").orderBy("y").collect()] == [1.0, 0.0, 0.0]


def test_levels_are_in_value_order(spark):
    assert category_levels(spark.range(3, 12, 4), ["id"]) == {"id": ["3", "7", "11"]}


def _dense(stamps, y, periods):
    """The same model by a design matrix over all rows, each as often as it stands."""
    at = stamps.to_numpy().astype("datetime64[us]").astype("int64") / 86_400e6
    first, last = at.min(), at.max()
    days, span, scale = np.unique(np.floor(at)), max(last - first, 1.0), np.abs(y).max()
    spots = series._spots(days)
    x = series._design(at, first, span, spots, len(np.unique(at)) > len(days))
    target = y / scale
    around = lambda beta: ((target - x @ beta) ** 2).mean()
    beta, noise, size = series._solve(x.T @ x, x.T @ target, target.var(), len(spots), around)
    ahead = np.concatenate([np.unique(at), last + np.arange(1, periods + 1)])
    timed = len(np.unique(at)) > len(days)
    yhat = series._design(ahead, first, span, spots, timed) @ beta
    return yhat * scale, series._half_width(ahead, last, span, noise, size) * scale


@pytest.fixture
def hourly():
    rng = np.random.default_rng(3)
    at = pd.to_datetime("2023-01-01") + pd.to_timedelta(rng.integers(0, 40 * 24, 3000), unit="h")
    hours = (at - at.min()).total_seconds().to_numpy() / 3600
    y = 50 + 0.02 * hours + 9 * np.sin(2 * np.pi * hours / 24) + 4 * np.cos(2 * np.pi * hours / 168) + rng.normal(0, 1, len(at))
    return pd.DataFrame({"at": at, "v": y})


@pytest.mark.parametrize("per_part", [100_000, 50])
def test_forecast_of_rows_equals_a_dense_solve(spark, hourly, monkeypatch, per_part):
    monkeypatch.setattr(series, "STAMPS_PER_PART", per_part)
    monkeypatch.setattr(series, "MERGED_AT_ONCE", 4)
    df = spark.createDataFrame(hourly).withColumn("at", F.col("at").cast("timestamp_ntz")).repartition(3)
    got = series.forecast_rows(df, "at", "v", 5).toPandas().sort_values("ds").reset_index(drop=True)
    yhat, half = _dense(hourly["at"], hourly["v"].to_numpy(), 5)
    assert len(got) == hourly["at"].nunique() + 5 and got["ds"].iloc[-1] == hourly["at"].max() + pd.Timedelta(days=5)
    np.testing.assert_allclose(got["yhat"], yhat, rtol=1e-7)
    np.testing.assert_allclose(got["yhat_upper"] - got["yhat"], half, rtol=1e-5)
    noon, night = (got[got["ds"].dt.hour == h]["yhat"].mean() for h in (6, 18))
    assert noon - night > 12  # the season within the day


def test_forecast_of_rows_by_key_and_odd_rows(spark, hourly):
    days = [(k, f"2024-01-{1 + d:02d}", float(d)) for k in ("a", None) for d in range(20)]
    odd = [("b", "2024-01-05", 7.0), ("c", None, 1.0), ("c", "2024-01-01", None), ("z", "2024-01-01", 0.0)]
    df = spark.createDataFrame(days + odd, "k string, day string, v double").withColumn("day", F.col("day").cast("date"))
    got = series.forecast_rows(df, "day", "v", 3, by=["k"]).toPandas()
    sizes = {k: len(v) for k, v in got.groupby("k", dropna=False)}
    assert {("" if pd.isna(k) else k): n for k, n in sizes.items()} == {"a": 23, "": 23, "b": 4, "z": 4}
    a = got[got["k"] == "a"].sort_values("ds")["yhat"].to_numpy()
    assert abs(a[-1] - 22) < 1.5 and set(got["ds"].dt.hour) == {0}
    assert series.forecast_rows(df.where("k = 'c'"), "day", "v", 3, by=["k"]).count() == 0
    assert series.forecast_rows(df.where("k = 'c'"), "day", "v", 3).count() == 0
