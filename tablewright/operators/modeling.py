"""Training, evaluation and batch scoring with Spark ML."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import (
    Imputer,
    ImputerModel,
    IndexToString,
    OneHotEncoder,
    SQLTransformer,
    StringIndexer,
    StringIndexerModel,
    VectorAssembler,
    VectorSlicer,
)
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.columns import is_boolean, is_datetime, is_nested, is_numeric, missing, number, present, ref
from tablewright.functions.reports import statistics
from tablewright.functions.values import most_frequent
from tablewright.operators.boosting import BoostedTreesModel, boost
from tablewright.operators.columns import epoch_nanos, epoch_nanos_sql
from tablewright.operators.features import one_hot
from tablewright.operators.forest import MOST_DEPTH, GrownForestModel, grow
from tablewright.operators.metrics import classification_metrics, regression_metrics

# Names of the algorithms and the parameters they are trained with.
ALGORITHMS = ("Linear Regression", "Logistic Regression", "Random Forest", "XGBoost")
ROUNDS = 200
LEARNING_RATE = 0.1
MAX_ITERATIONS = 1000
SEED = 42
TEST_SIZE = 0.2
FEW_VALUES = 10

# Shape of the trees: of a forest as in Spark's own defaults, of boosted trees as usual for them.
TREES = {"Random Forest": {"max_depth": 5, "max_bins": 32}, "XGBoost": {"max_depth": 6, "max_bins": 256}}

SPLIT_STEPS = 10_000
_FIRST_LOOK = 100_000


def problem_type(df: DataFrame, target: str) -> str:
    """``regression`` for a numeric target with more than ten values, else ``classification``."""
    dtype = df.schema[target].dataType
    if not (is_numeric(dtype) or is_boolean(dtype)):
        return "classification"
    values = df.select(present(df.schema[target]).alias("v")).where("v IS NOT NULL")
    # More than ten values among the first rows settles it without a shuffle of all values.
    if values.limit(_FIRST_LOOK).distinct().limit(FEW_VALUES + 1).count() > FEW_VALUES:
        return "regression"
    few = values.distinct().limit(FEW_VALUES + 1).count() <= FEW_VALUES
    return "classification" if few else "regression"


def design_matrix(df: DataFrame, target: str) -> DataFrame:
    """Plain numeric feature columns next to the target.

    Datetimes become nanoseconds, text columns flags without their first value,
    missing numbers the column mean, missing flags 0; rows without a target are dropped.
    """
    features = [f for f in df.schema.fields if f.name != target]
    dates = {f.name: epoch_nanos(f) for f in features if is_datetime(f.dataType)}
    source = df.withColumns(dates) if dates else df
    texts = [f.name for f in features if isinstance(f.dataType, T.StringType)]
    wide = one_hot(source, texts, drop_first=True) if texts else source
    names = [c for c in wide.columns if c != target]
    numeric = [c for c in names if is_numeric(wide.schema[c].dataType)]
    means = statistics(wide, {c: F.avg(number(wide, c)) for c in numeric}) if numeric else {}
    gap = {c: means[c] if c in numeric else 0.0 for c in names}  # an absent flag counts as not set
    value = {c: number(wide, c) if c in numeric else ref(c).cast("double") for c in names}
    prepared = [F.coalesce(value[c], F.lit(gap[c])).alias(c) for c in names]
    return wide.where(~missing(wide.schema[target])).select(*prepared, ref(target))


def hash_split(
    df: DataFrame, keys: list[str] | None = None, test_size: float = TEST_SIZE, seed: int = SEED
) -> tuple[DataFrame, DataFrame]:
    """Train and test part by a hash of the key columns (all columns by default).

    The part of a row depends on its keys and the seed only, not on partitioning
    or on which executor reads it, so both parts stay disjoint after a retry.
    """
    if not 0 < test_size < 1:
        raise ValueError("test_size must lie between 0 and 1")
    names = keys or [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    step = F.pmod(F.xxhash64(*[ref(c) for c in names], F.lit(seed)), F.lit(SPLIT_STEPS))
    in_test = step < int(round(test_size * SPLIT_STEPS))
    return df.where(~in_test), df.where(in_test)


@dataclass(frozen=True)
class TrainedModel:
    """A fitted pipeline with what is needed to score and explain it."""

    pipeline: PipelineModel
    target: str
    target_type: str
    problem: str
    algorithm: str
    metrics: dict[str, float]
    features: list[str]
    inputs: dict[str, str] = field(default_factory=dict)
    trees: dict[str, int] = field(default_factory=dict)

    def score(self, df: DataFrame, defaults: dict[str, object] | None = None) -> DataFrame:
        """Batch scoring: ``df`` plus ``prediction``.

        Feature columns that ``df`` lacks are filled from ``defaults``.
        """
        added = {
            name: F.lit((defaults or {}).get(name)).cast(dtype)
            for name, dtype in self.inputs.items()
            if name not in df.columns
        }
        source = df.withColumns(added) if added else df
        scored = self.pipeline.transform(source)
        kept = [ref(c) for c in df.columns if c != "prediction"]
        if self.problem == "classification":
            return scored.select(*kept, F.col("__predicted_class").cast(self.target_type).alias("prediction"))
        return scored.select(*kept, F.col("__raw_prediction").alias("prediction"))

    def save(self, path: str) -> None:
        """Write the pipeline and its description under ``path``."""
        spark = SparkSession.active()
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        about = {k: getattr(self, k) for k in ("target", "target_type", "problem", "algorithm", "metrics", "features", "inputs", "trees")}
        spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.mode("overwrite").parquet(
            f"{path}/about"
        )

    @staticmethod
    def load(path: str) -> "TrainedModel":
        spark = SparkSession.active()
        about = json.loads(spark.read.parquet(f"{path}/about").first()["about"])
        return TrainedModel(pipeline=PipelineModel.load(f"{path}/pipeline"), **about)


def train(
    df: DataFrame,
    target: str,
    algorithm: str,
    test_size: float = TEST_SIZE,
    seed: int = SEED,
    split_keys: list[str] | None = None,
    rounds: int = ROUNDS,
    features: list[str] | None = None,
    trees: dict[str, int] | None = None,
) -> TrainedModel:
    """Split, fit on one part and evaluate on the other.

    Encoders and means come from the training part only.  ``trees`` overrides
    entries of ``TREES``: ``max_depth`` (a forest allows 30, boosting 12) and ``max_bins``.
    """
    problem = _checked_problem(df, target, algorithm)
    rows = df.where(~missing(df.schema[target]))
    train_rows, test_rows = hash_split(rows, split_keys, test_size, seed)
    model = _fit(train_rows, target, algorithm, problem, seed, rounds, features, trees)
    model.metrics.update(evaluate(model, test_rows))
    return model


def fit(
    df: DataFrame,
    target: str,
    algorithm: str,
    seed: int = SEED,
    rounds: int = ROUNDS,
    features: list[str] | None = None,
    trees: dict[str, int] | None = None,
) -> TrainedModel:
    """Fit on all rows that have a target, without evaluation."""
    problem = _checked_problem(df, target, algorithm)
    rows = df.where(~missing(df.schema[target]))
    return _fit(rows, target, algorithm, problem, seed, rounds, features, trees)


def _checked_problem(df: DataFrame, target: str, algorithm: str) -> str:
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unsupported algorithm: {algorithm!r}")
    problem = problem_type(df, target)
    if algorithm == "Linear Regression" and problem == "classification":
        raise ValueError("Linear Regression needs a numeric target with more than ten values")
    if algorithm == "Logistic Regression" and problem == "regression":
        raise ValueError("Logistic Regression needs a target with few classes")
    return problem


def _fit(
    rows: DataFrame,
    target: str,
    algorithm: str,
    problem: str,
    seed: int,
    rounds: int,
    features: list[str] | None,
    trees: dict[str, int] | None,
) -> TrainedModel:
    known = TREES.get(algorithm, {})
    if set(trees or {}) - {"max_depth", "max_bins"}:
        raise ValueError(f"unknown tree options: {sorted(set(trees) - {'max_depth', 'max_bins'})}")
    shape = known | (trees or {}) if known else {}
    usable = [f for f in rows.schema.fields if f.name != target and not is_nested(f.dataType)]
    if features is not None:
        usable = [f for f in usable if f.name in features]
    if not usable:
        raise ValueError("no usable feature column")
    stages, names = _feature_stages(rows, usable)
    prepared = PipelineModel(stages).transform(rows)
    if known:
        numbers = [c for s in stages if isinstance(s, ImputerModel) for c in s.getOutputCols()]
        flags = tuple(len(s.getIndices()) for s in stages if isinstance(s, VectorSlicer))
        shape = shape | {"numbers": numbers, "names": len(names), "flags": flags}
    fitter = _fit_classifier if problem == "classification" else _fit_regressor
    return TrainedModel(
        pipeline=PipelineModel([*stages, *fitter(prepared, target, algorithm, seed, rounds, shape)]),
        target=target,
        target_type=rows.schema[target].dataType.simpleString(),
        problem=problem,
        algorithm=algorithm,
        metrics={},
        features=names,
        inputs={f.name: f.dataType.simpleString() for f in usable},
        trees={k: shape[k] for k in known},
    )


def evaluate(model: TrainedModel, rows: DataFrame) -> dict[str, float]:
    """Metrics of the model on labelled rows."""
    scored = model.score(rows)
    if model.problem == "classification":
        found = classification_metrics(scored, model.target, "prediction").first()
    else:
        found = regression_metrics(scored, model.target, "prediction").first()
    return found.asDict()


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _feature_stages(rows: DataFrame, fields: list[T.StructField]) -> tuple[list, list[str]]:
    """Fitted stages from raw columns to the vector ``__features``, and its names."""
    texts = [f for f in fields if isinstance(f.dataType, T.StringType)]
    numbers = [f for f in fields if f not in texts]
    counts = statistics(rows, {f.name: F.count(present(f)) for f in numbers}) if numbers else {}
    numbers = [f for f in numbers if counts[f.name] > 0]

    casts = []
    for i, f in enumerate(numbers):
        value = epoch_nanos_sql(f) if is_datetime(f.dataType) else _quoted(f.name)
        casts.append(f"CAST({value} AS DOUBLE) AS `__n{i}`")
    casts += [f"{_quoted(f.name)} AS `__t{i}`" for i, f in enumerate(texts)]
    stages: list = [SQLTransformer(statement=f"SELECT *, {', '.join(casts)} FROM __THIS__")]
    shaped = stages[0].transform(rows)
    parts, names = [], []

    if numbers:
        columns = [f"__n{i}" for i in range(len(numbers))]
        filled = [f"{c}_filled" for c in columns]
        stages.append(Imputer(strategy="mean", inputCols=columns, outputCols=filled).fit(shaped))
        stages.append(VectorAssembler(inputCols=filled, outputCol="__numbers", handleInvalid="keep"))
        parts.append("__numbers")
        names += [f.name for f in numbers]

    if texts:
        columns = [f"__t{i}" for i in range(len(texts))]
        indexed, encoded = [f"{c}_index" for c in columns], [f"{c}_flags" for c in columns]
        # Descending order puts the first value last, where it can be sliced off
        # together with the slot for missing and unseen values.
        indexer = StringIndexer(
            inputCols=columns, outputCols=indexed, stringOrderType="alphabetDesc", handleInvalid="keep"
        ).fit(shaped)
        encoder = OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True).fit(indexer.transform(shaped))
        stages += [indexer, encoder]
        for f, column, labels in zip(texts, encoded, indexer.labelsArray):
            if len(labels) < 2:
                continue
            kept = f"{column}_kept"
            stages.append(VectorSlicer(inputCol=column, outputCol=kept, indices=list(range(len(labels) - 1))))
            parts.append(kept)
            names += [f"{f.name}_{label}" for label in labels[:-1]]

    if not parts:
        raise ValueError("no feature column holds more than one value")
    stages.append(VectorAssembler(inputCols=parts, outputCol="__features", handleInvalid="keep"))
    return stages, names


def _fit_classifier(
    prepared: DataFrame, target: str, algorithm: str, seed: int, rounds: int, shape: dict[str, int]
) -> list:
    text_target = prepared.withColumn("__target", ref(target).cast("string"))
    classes = text_target.groupBy("__target").count().collect()  # one row per class
    labels = sorted(r["__target"] for r in classes)
    indexer = StringIndexerModel.from_labels(labels, inputCol="__target", outputCol="__label")
    labelled = indexer.transform(text_target).select("__features", "__label", *shape.get("numbers", []))
    common = {"featuresCol": "__features", "labelCol": "__label", "predictionCol": "__raw_prediction"}
    back = IndexToString(inputCol="__raw_prediction", outputCol="__predicted_class", labels=labels)
    if algorithm == "XGBoost":
        return [_boosted(labelled, len(labels), rounds, shape), back]
    if algorithm == "Random Forest" and shape["max_depth"] <= MOST_DEPTH:
        return [_grown(labelled, len(labels), rounds, shape, seed), back]
    if algorithm == "Logistic Regression":
        # Penalty of a unit-strength L2 term, expressed per training row.
        strength = 1.0 / sum(r["count"] for r in classes)
        estimator = LogisticRegression(maxIter=MAX_ITERATIONS, regParam=strength, standardization=False, **common)
    else:
        grown = {"maxDepth": shape["max_depth"], "maxBins": shape["max_bins"], "seed": seed}
        estimator = RandomForestClassifier(numTrees=rounds, **grown, **common)
    return [estimator.fit(labelled), back]


def _fit_regressor(
    prepared: DataFrame, target: str, algorithm: str, seed: int, rounds: int, shape: dict[str, int]
) -> list:
    own = shape.get("numbers", [])
    labelled = prepared.select("__features", number(prepared, target).alias("__label"), *own)
    if algorithm == "XGBoost":
        return [_boosted(labelled, None, rounds, shape)]
    if algorithm == "Random Forest" and shape["max_depth"] <= MOST_DEPTH:
        return [_grown(labelled, None, rounds, shape, seed)]
    common = {"featuresCol": "__features", "labelCol": "__label", "predictionCol": "__raw_prediction"}
    if algorithm == "Linear Regression":
        estimator = LinearRegression(regParam=0.0, **common)
    else:
        grown = {"maxDepth": shape["max_depth"], "maxBins": shape["max_bins"], "seed": seed}
        estimator = RandomForestRegressor(numTrees=rounds, **grown, **common)
    return [estimator.fit(labelled)]


def _boosted(labelled: DataFrame, classes: int | None, rounds: int, shape: dict) -> BoostedTreesModel:
    """Boosted trees over the prepared features, all classes in one model."""
    return boost(
        labelled, "__features", "__label", shape["numbers"], shape["names"], classes,
        rounds, LEARNING_RATE, shape["max_depth"], shape["max_bins"], shape["flags"],
    )


def _grown(labelled: DataFrame, classes: int | None, rounds: int, shape: dict, seed: int) -> GrownForestModel:
    """A forest over the prepared features."""
    return grow(
        labelled, "__features", "__label", shape["numbers"], shape["names"], classes,
        rounds, shape["max_depth"], shape["max_bins"], shape["flags"], seed,
    )


def _importances(stage) -> list[float] | None:
    if hasattr(stage, "featureImportances"):
        return stage.featureImportances.toArray().tolist()
    if hasattr(stage, "coefficientMatrix"):
        return abs(stage.coefficientMatrix.toArray()).sum(axis=0).tolist()
    if hasattr(stage, "coefficients"):
        return abs(stage.coefficients.toArray()).tolist()
    return None


def feature_importance(model: TrainedModel, top: int | None = None) -> DataFrame | None:
    """``(feature, importance)``, largest first; None if the model has no such notion.

    Tree importances, or the size of the coefficients summed over classes.
    """
    for stage in model.pipeline.stages:
        if not (stage.hasParam("predictionCol") and stage.getOrDefault("predictionCol") == "__raw_prediction"):
            continue
        values = _importances(stage)
        if values is None:
            return None
        pairs = sorted(zip(model.features, values), key=lambda pair: -pair[1])
        rows = pairs if top is None else pairs[:top]
        return SparkSession.active().createDataFrame(rows, "feature string, importance double")
    return None


def default_values(df: DataFrame, features: list[str] | None = None) -> dict[str, object]:
    """A value per column to stand in for an absent one: mean of numbers, else the mode."""
    fields = [f for f in df.schema.fields if not is_nested(f.dataType) and (features is None or f.name in features)]
    numbers = [f.name for f in fields if is_numeric(f.dataType)]
    others = [f.name for f in fields if f.name not in numbers]
    found = statistics(df, {c: F.avg(number(df, c)) for c in numbers}) if numbers else {}
    modes = most_frequent(df, others) if others else {}
    return {f.name: found[f.name] if f.name in numbers else modes[f.name][0] for f in fields}


def default_value_table(df: DataFrame, features: list[str] | None = None) -> DataFrame:
    """The defaults as ``(column, value)`` in text form."""
    rows = [(c, None if v is None else str(v)) for c, v in default_values(df, features).items()]
    return df.sparkSession.createDataFrame(rows, "column string, value string")
