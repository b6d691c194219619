"""Model quality from a table with a label and a prediction column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import number, ref


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """``(label, prediction, n)`` over rows that have both."""
    return (
        df.select(ref(label).alias("label"), ref(prediction).alias("prediction"))
        .dropna()
        .groupBy("label", "prediction")
        .agg(F.count("*").alias("n"))
    )


def classification_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """``(accuracy, f1, precision, recall)``; the last three weighted by class size.

    A class that is never predicted has precision 0.  Everything follows from the
    confusion counts: one shuffle of already counted rows.
    """
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("label").cast("string").alias("class"), F.col("n").alias("actual"), zero.alias("predicted"), hit.cast("bigint").alias("hits")),
        F.struct(F.col("prediction").cast("string").alias("class"), zero.alias("actual"), F.col("n").alias("predicted"), zero.alias("hits")),
    )
    per_class = (
        confusion(df, label, prediction)
        .select(F.inline(sides))
        .groupBy("class")
        .agg(*[F.sum(c).cast("double").alias(c) for c in ("actual", "predicted", "hits")])
    )
    none = F.lit(0.0)
    precision = F.coalesce(F.try_divide("hits", "predicted"), none)
    recall = F.coalesce(F.try_divide("hits", "actual"), none)
    f1 = F.coalesce(F.try_divide(2 * F.col("hits"), F.col("actual") + F.col("predicted")), none)
    total = F.sum("actual")
    return per_class.agg(
        F.try_divide(F.sum("hits"), total).alias("accuracy"),
        F.try_divide(F.sum(f1 * F.col("actual")), total).alias("f1"),
        F.try_divide(F.sum(precision * F.col("actual")), total).alias("precision"),
        F.try_divide(F.sum(recall * F.col("actual")), total).alias("recall"),
    )


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """``(rmse, r2)`` over rows that have both, in one pass."""
    truth, guess = number(df, label), number(df, prediction)
    pairs = df.select(truth.alias("t"), guess.alias("p")).dropna()
    error = F.avg(F.pow(F.col("t") - F.col("p"), F.lit(2.0)))
    spread = F.var_pop("t")
    r2 = F.when(spread > 0, 1 - F.try_divide(error, spread)).when(error == 0, 1.0).when(error > 0, 0.0)
    return pairs.agg(F.sqrt(error).alias("rmse"), r2.alias("r2"))
