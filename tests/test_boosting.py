import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tablewright.operators import boosting, modeling


@pytest.fixture(scope="module")
def shops(spark):
    rng = np.random.default_rng(11)
    rows = [
        (i, float(x), k, float(np.sin(x) * 3 + (2 if k == "b" else 0) + e), "abc"[int(x) % 3])
        for i, (x, k, e) in enumerate(zip(rng.uniform(0, 9, 900).round(2), rng.choice(list("abd"), 900), rng.normal(0, 0.1, 900)))
    ]
    return spark.createDataFrame(rows, "id bigint, x double, k string, y double, c string").cache()


def plain_first_tree(x, y, depth, rate=0.1):
    """One tree over one feature by trying every limit, one bin per value."""
    start = y.mean()

    def grow(part, left):
        g, h = (start - y[part]).sum(), float(part.sum())
        best = None
        for cut in np.unique(x[part])[1:]:
            low = part & (x < cut)
            gl, hl = (start - y[low]).sum(), float(low.sum())
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            if gain > 1e-6 and (best is None or gain > best[0] + 1e-9 * max(1, abs(gain))):
                best = (gain, low)
        if left == 0 or best is None:
            return np.where(part, -rate * g / (h + 1), 0.0)
        return grow(best[1], left - 1) + grow(part & ~best[1], left - 1)

    return start + grow(np.ones(len(x), bool), depth)


@pytest.mark.parametrize("depth", [1, 3])
def test_first_tree_equals_trying_every_limit(spark, depth):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 40, 500).astype(float)
    y = (x % 7) * 3 + rng.normal(0, 1, 500)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    model = modeling.fit(df, "y", "XGBoost", rounds=1, trees={"max_depth": depth})
    found = {r["x"]: r["prediction"] for r in model.score(df).collect()}
    wanted = dict(zip(x, plain_first_tree(x, y, depth)))
    assert found.keys() == wanted.keys()
    assert all(found[v] == pytest.approx(wanted[v], abs=1e-9) for v in wanted)


@pytest.mark.parametrize("target", ["y", "c"])
def test_spark_and_one_task_grow_the_same_trees(shops, target, monkeypatch):
    data = shops.select("x", "k", target)
    options = {"rounds": 5, "trees": {"max_depth": 3, "max_bins": 32}}
    here = modeling.fit(data, target, "XGBoost", **options)
    monkeypatch.setattr(boosting, "LOCAL_CELLS", 0)
    monkeypatch.setattr(boosting, "REWRITE", 2)
    monkeypatch.setattr(boosting, "HELD_SUMS", 1)  # one class a pass
    there = modeling.fit(data, target, "XGBoost", **options)
    one, other = (
        next(s for s in m.pipeline.stages if isinstance(s, boosting.BoostedTreesModel)).forest for m in (here, there)
    )
    assert one.leaf.shape == (5, 1 if target == "y" else 3, 8)
    assert (one.feature == other.feature).all() and (one.limit == other.limit).all()
    assert np.allclose(one.leaf, other.leaf, atol=1e-9)


def test_many_classes_by_one_model(shops):
    model = modeling.train(shops.select("id", "x", "k", "c"), "c", "XGBoost", features=["x", "k"], split_keys=["id"], rounds=20)
    assert model.metrics["accuracy"] > 0.95
    assert modeling.feature_importance(model).first()["feature"] == "x"


def test_regression_learns_a_curve(shops):
    model = modeling.train(shops.drop("c"), "y", "XGBoost", features=["x", "k"], split_keys=["id"], rounds=60)
    assert model.metrics["r2"] > 0.97


def test_saved_and_loaded(shops, tmp_path):
    model = modeling.fit(shops.select("x", "k", "c"), "c", "XGBoost", rounds=3)
    model.save(str(tmp_path / "m"))
    again = modeling.TrainedModel.load(str(tmp_path / "m"))
    rows = shops.select("id", "x", "k")
    pairs = model.score(rows).join(again.score(rows).withColumnRenamed("prediction", "p2"), "id")
    assert pairs.where(F.col("prediction") != F.col("p2")).count() == 0
    assert again.trees == {"max_depth": 6, "max_bins": 256}


def test_equal_rows_are_one_row_with_a_count(shops):
    limits = [np.array([3.0, 6.0])]
    rows = VectorAssembler(inputCols=["x"], outputCol="f").transform(shops)
    binned = boosting._binned_rows(rows, "f", "y", limits, "regression")
    assert binned.count() == 3
    totals = binned.agg(F.sum("weight").alias("n"), F.sum("label").alias("y")).first()
    assert totals["n"] == 900 and totals["y"] == pytest.approx(shops.agg(F.sum("y")).first()[0])


def test_odd_tables(spark):
    """Constant features, missing values, one class, infinite numbers."""
    df = spark.createDataFrame(
        [(1.0, None, "q"), (None, 2.0, "q"), (float("inf"), 2.0, "q"), (float("nan"), 2.0, "q")], "a double, b double, t string"
    )
    model = modeling.fit(df, "t", "XGBoost", rounds=2)
    assert {r["prediction"] for r in model.score(df).collect()} == {"q"}
    flat = spark.range(50).selectExpr("CAST(1 AS DOUBLE) AS a", "CAST(id AS DOUBLE) AS y")
    answers = [r["prediction"] for r in modeling.fit(flat, "y", "XGBoost", rounds=2).score(flat).collect()]
    assert answers == pytest.approx([24.5] * 50)


def test_options(shops):
    with pytest.raises(ValueError, match="max_depth"):
        modeling.fit(shops.select("x", "y"), "y", "XGBoost", trees={"max_depth": 30})
    with pytest.raises(ValueError, match="max_bins"):
        modeling.fit(shops.select("x", "y"), "y", "XGBoost", trees={"max_bins": 1000})
    with pytest.raises(ValueError, match="unknown"):
        modeling.fit(shops.select("x", "y"), "y", "XGBoost", trees={"leaves": 3})
