import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.operators import cleaning, outliers, profile
from tests.conftest import SF, rows


def column(df, name, key="id"):
    return [r[name] for r in df.orderBy(key).collect()]


def test_missing_summary_counts_nan(quirks):
    found = {r["column"]: r for r in cleaning.missing_summary(quirks).collect()}
    assert found["x"]["missing_count"] == 2 and found["x"]["missing_pct"] == 40.0
    assert found["empty"]["missing_count"] == 5 and found["odd.name"]["missing_count"] == 1
    empty = {r["column"]: r["missing_pct"] for r in cleaning.missing_summary(quirks.limit(0)).collect()}
    assert empty["x"] is None


def test_fill_mean_and_median(quirks):
    mean = cleaning.fill_missing(quirks, "mean")
    assert column(mean, "x") == [1.0, 35.0, 35.0, 4.0, 100.0]
    assert column(mean, "odd.name") == [10.0, 20.25, 30.0, 30.0, 11.0]
    assert mean.schema["id"].dataType.simpleString() == "bigint"
    assert column(mean, "empty") == [None] * 5
    assert column(mean, "k") == ["a", "a", "b", "b", None]
    median = cleaning.fill_missing(quirks, "median")
    assert column(median, "x") == [1.0, 4.0, 4.0, 4.0, 100.0]
    assert column(median, "odd.name") == [10.0, 20.5, 30.0, 30.0, 11.0]


def test_fill_mode_takes_smallest_of_ties(quirks):
    filled = cleaning.fill_missing(quirks, "mode")
    assert column(filled, "x") == [1.0, 1.0, 1.0, 4.0, 100.0]
    assert column(filled, "k")[4] == "a"
    assert column(filled, "b")[2] is True
    assert column(filled, "odd.name")[1] == 30
    assert column(filled, "empty") == [None] * 5
    assert filled.schema.simpleString() == quirks.schema.simpleString()


def test_fill_constant_keeps_types(quirks):
    filled = cleaning.fill_missing(quirks, "constant", "0")
    assert column(filled, "x")[1:3] == [0.0, 0.0] and column(filled, "k")[4] == "0"
    word = cleaning.fill_missing(quirks, "constant", "none")
    assert column(word, "k")[4] == "none" and column(word, "x")[2] is None
    assert word.schema.simpleString() == quirks.schema.simpleString()


def test_drop_and_unknown_strategy(quirks):
    assert cleaning.fill_missing(quirks, "drop").count() == 0
    assert cleaning.fill_missing(quirks.drop("empty"), "drop").count() == 2
    with pytest.raises(ValueError):
        cleaning.fill_missing(quirks, "guess")


def test_duplicates_treat_missing_as_equal(spark, monkeypatch):
    df = spark.createDataFrame(
        [(1.0, None), (1.0, None), (float("nan"), "a"), (None, "a"), (2.0, "b")], "x double, k string"
    )
    assert cleaning.duplicate_count(df).first()[0] == 4
    assert rows(cleaning.duplicate_rows(df)) == [(1.0, None), (1.0, None), (None, "a"), (None, "a")]
    assert cleaning.duplicate_count(df.limit(0)).first()[0] == 0
    monkeypatch.setattr(cleaning, "COPIES_PER_TASK_ROW", 7)
    heavy = spark.range(1000).select(F.when(F.col("id") % 3 != 0, F.col("id")).otherwise(0).alias("v"))  # a third of the rows is 0
    got = cleaning.duplicate_rows(heavy).groupBy("v").count().collect()
    assert [(r["v"], r["count"]) for r in got] == [(0, 334)]


def test_outliers_on_the_fence_stay(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 8.0, 8.01]  # fences of the first five: -1 and 7
    df = spark.createDataFrame([(v,) for v in [1.0, 2.0, 3.0, 4.0]] + [(None,)], "x double")
    low, high = outliers.iqr_fences(df, ["x"])["x"]
    on_fence = df.union(spark.createDataFrame([(float("nan"),)], "x double"))
    assert outliers.iqr_fences(on_fence, ["x"])["x"] == (low, high)
    got = outliers.outlier_summary(spark.createDataFrame([(v,) for v in values], "x double")).first()
    frame = pd.Series(values)
    reach = 1.5 * (frame.quantile(0.75) - frame.quantile(0.25))
    expected = ((frame < frame.quantile(0.25) - reach) | (frame > frame.quantile(0.75) + reach)).sum()
    assert got["num_outliers"] == expected


def test_outliers_of_empty_table_and_column(quirks):
    found = {r["column"]: r for r in outliers.outlier_summary(quirks.limit(0)).collect()}
    assert found["x"]["num_outliers"] == 0 and found["x"]["pct_outliers"] == 0.0
    assert {r["column"]: r["num_outliers"] for r in outliers.outlier_summary(quirks).collect()}["empty"] == 0


def test_remove_outliers_is_sequential(spark):
    rng = np.random.default_rng(1)
    data = pd.DataFrame({"id": range(400), "a": rng.lognormal(0, 1.2, 400)})
    data["b"] = data["a"] ** 2 + rng.normal(0, 1, 400)
    data.loc[::37, "b"] = np.nan
    kept = data
    for name in ("a", "b"):
        q1, q3 = kept[name].quantile(0.25), kept[name].quantile(0.75)
        reach = 1.5 * (q3 - q1)
        kept = kept[(kept[name] >= q1 - reach) & (kept[name] <= q3 + reach)]
    got = outliers.remove_outliers(spark.createDataFrame(data), ["a", "b"])
    assert sorted(r["id"] for r in got.collect()) == kept["id"].tolist()


def test_numeric_summary_equals_pandas(spark):
    pdf = pd.read_parquet(f"{SF}/lineitem.parquet")[["l_quantity", "l_extendedprice", "l_tax"]]
    pdf.loc[::9, "l_tax"] = np.nan
    expected = pdf.describe().T.assign(skew=pdf.skew(), kurtosis=pdf.kurtosis()).round(4)
    got = profile.numeric_summary(spark.createDataFrame(pdf)).toPandas().set_index("column")
    np.testing.assert_allclose(got.loc[expected.index].to_numpy(float), expected.to_numpy(float), atol=1.01e-4)


def test_numeric_summary_of_small_columns(spark, quirks):
    got = {r["column"]: r for r in profile.numeric_summary(quirks).collect()}
    assert got["constant"]["skew"] == 0.0 and got["constant"]["kurtosis"] == 0.0 and got["constant"]["std"] == 0.0
    assert got["empty"]["count"] == 0 and got["empty"]["mean"] is None and got["empty"]["p50"] is None
    assert got["x"]["count"] == 3 and got["x"]["skew"] is not None and got["x"]["kurtosis"] is None
    one = {r["column"]: r for r in profile.numeric_summary(quirks.limit(1)).collect()}
    assert one["x"]["std"] is None and one["x"]["skew"] is None
    assert profile.numeric_summary(quirks.select("k")).count() == 0


def test_categorical_summary(quirks):
    got = {r["column"]: tuple(r)[1:] for r in profile.categorical_summary(quirks).collect()}
    assert got == {"k": (2, "a", 2), "b": (2, "true", 3)}
    gaps = quirks.withColumn("k", F.when(F.col("id") > 3, F.lit("z")))
    assert tuple(profile.categorical_summary(gaps, ["k"]).first())[1:] == (1, None, 3)


def test_correlation_is_pairwise_and_safe(spark, quirks):
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in profile.correlation_matrix(quirks).collect()}
    pdf = quirks.toPandas()[["id", "x", "constant", "empty", "odd.name"]].astype(float)
    expected = pdf.corr()
    assert len(got) == 25
    for a in expected.columns:
        for b in expected.columns:
            if np.isnan(expected.loc[a, b]):
                assert got[a, b] is None
            else:
                assert got[a, b] == pytest.approx(expected.loc[a, b])
    assert profile.pair_correlation(quirks, "id", "constant").first()["corr"] is None


def test_correlation_of_many_columns_in_blocks(spark):
    wide = spark.range(50).select(*[(F.col("id") * i + F.sin(F.col("id") * i)).alias(f"c{i}") for i in range(1, 18)])
    got = profile.correlation_matrix(wide).toPandas().pivot(index="col_a", columns="col_b", values="corr")
    expected = wide.toPandas().corr()
    np.testing.assert_allclose(got.loc[expected.index, expected.columns].to_numpy(), expected.to_numpy(), atol=1e-9)


def test_correlation_of_wide_tables(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(400, 4))
    pdf = pd.DataFrame(base @ rng.normal(size=(4, 30)) + rng.normal(size=(400, 30)), columns=[f"c{i}" for i in range(30)])
    pdf["c1"] = pdf["c1"] * 1e-14  # tiny, yet not constant
    pdf["c2"] = pdf["c2"] + 1e9
    pdf["flat"] = 3.0
    pdf.loc[::7, "c3"] = np.nan
    pdf.loc[::5, "c4"] = np.nan
    got = profile.correlation_matrix(spark.createDataFrame(pdf)).toPandas()
    assert len(got) == 31 * 31
    got = got.pivot(index="col_a", columns="col_b", values="corr").astype(float)
    expected = pdf.corr()
    np.testing.assert_allclose(got.loc[expected.index, expected.columns].to_numpy(), expected.to_numpy(), atol=1e-6)
    assert np.array_equal(np.diag(got.drop(index="flat", columns="flat")), np.ones(30))
    assert profile.correlation_matrix(spark.createDataFrame(pdf).limit(0)).where("corr IS NOT NULL").count() == 0


def test_key_figures(quirks):
    row = profile.key_figures(quirks, mean_of="x", median_of="x", sum_of="empty", unique_of="k").first()
    assert tuple(row) == (5, 7, 10, 35.0, 4.0, 0.0, 2)
    empty = profile.key_figures(quirks.limit(0), mean_of="x", median_of="x", sum_of="x", unique_of="k").first()
    assert tuple(empty) == (0, 7, 0, None, None, 0.0, 0)


def test_sketches_come_close(spark):
    df = spark.range(50_000).select(F.randn(3).alias("x"), (F.col("id") % 100).cast("string").alias("k"))
    close = profile.key_figures(df, median_of="x", unique_of="k", approx=True).first()
    exact = profile.key_figures(df, median_of="x", unique_of="k").first()
    assert close["median"] == pytest.approx(exact["median"], abs=0.01) and abs(close["unique"] - 100) <= 10
    one, two = (outliers.outlier_summary(df, ["x"], approx=a).first()["num_outliers"] for a in (True, False))
    assert abs(one - two) < 20
    gaps = df.withColumn("x", F.when(F.col("k") != "7", F.col("x")))
    assert cleaning.fill_missing(gaps, "median", approx=True).where("x IS NULL").count() == 0


def test_missing_rates(spark):
    df = spark.range(90).select("id", F.when(F.col("id") >= 45, 1.0).alias("v"))
    got = {r["bucket"]: (r["row_count"], r["v"]) for r in profile.missing_rates(df, "id", buckets=2).collect()}
    assert got == {0: (45, 1.0), 1: (45, 0.0)}
    assert profile.missing_rates(df.where("id = 3"), "id").first()["bucket"] == 0


def test_missing_patterns(quirks):
    got = rows(profile.missing_patterns(quirks, ["x", "k"]))
    assert got == [(0, 0, 2), (0, 1, 1), (1, 0, 2)]
