"""Gradient-boosted trees grown from histograms of the gradients.

The features are cut into bins once.  Rows with the same bins and the same label
become one row with a count, so a table with few different rows stays small however
long it is.  Flags of one text column share a code, so sums take one step per column.
From then on every level of every tree needs one sum per (class, node, column, code):
tasks add up their rows, Spark adds up the tasks, and only the chosen splits, one per
class and node, come back.  All classes of a round grow in the same pass, and the rows
stay in the executors with their margins.  A table that is small after the first step is
boosted by one task with the same functions.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.rdd import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tablewright.operators.treebins import Columns, bin_limits, coded
from tablewright.session import delete_path, scratch_path

# Penalty of large leaves, least weight of a child, least gain of a split.
LEAF_PENALTY = 1.0
LEAST_WEIGHT = 1.0
LEAST_GAIN = 1e-6

#: Trees are kept as complete ones, so that depth is bounded.
MOST_DEPTH = 12
MOST_BINS = 256
#: Different rows times columns that one task boosts by itself.
LOCAL_CELLS = 2_000_000
#: Sums (nodes times codes) that a task holds at a time; further classes take another pass.
HELD_SUMS = 4_000_000
#: Rounds after which the rows are written with their margins, so that no long chain of steps hangs on them.
REWRITE = 20
#: Rows of a task, at most, when the table is boosted in Spark.
TASK_ROWS = 1_000_000


@dataclass
class Forest:
    """The grown trees: ``[round, class, node]``, nodes of a complete tree level by level."""

    kind: str  # regression, binary or classes
    start: np.ndarray
    limits: list[np.ndarray]
    depth: int
    feature: np.ndarray
    limit: np.ndarray
    gain: np.ndarray
    leaf: np.ndarray
    groups: tuple[int, ...] = ()

    @classmethod
    def empty(
        cls, kind: str, start: np.ndarray, limits: list[np.ndarray], depth: int, groups: tuple[int, ...] = ()
    ) -> "Forest":
        inner, leaves = (0, len(start), 2**depth - 1), (0, len(start), 2**depth)
        return cls(
            kind, start, limits, depth, np.empty(inner, "int32"), np.empty(inner, "uint8"), np.empty(inner), np.empty(leaves), groups
        )

    @cached_property
    def columns(self) -> Columns:
        return Columns(self.limits, self.groups)

    def add_round(self) -> None:
        """A round of trees without splits, whose leaves are 0."""
        for name, value in (("feature", -1), ("limit", 0), ("gain", 0), ("leaf", 0)):
            old = getattr(self, name)
            setattr(self, name, np.concatenate([old, np.full((1, *old.shape[1:]), value, old.dtype)]))

    def since(self, first: int) -> "Forest":
        """The same with the trees from round ``first`` on."""
        parts = [getattr(self, name)[first:] for name in ("feature", "limit", "gain", "leaf")]
        return Forest(self.kind, self.start, self.limits, self.depth, *parts, self.groups)

    def node(self, codes: np.ndarray, turn: int, label: int, levels: int) -> np.ndarray:
        """The node of each row after ``levels`` levels of one tree."""
        return self.columns.walk(codes, self.feature[turn, label], self.limit[turn, label], levels)

    def raise_margins(self, codes: np.ndarray, margins: np.ndarray) -> np.ndarray:
        """``margins`` plus the leaves of all rounds."""
        margins = margins.copy()
        for turn in range(len(self.leaf)):
            for label in range(len(self.start)):
                margins[:, label] += self.leaf[turn, label][self.node(codes, turn, label, self.depth)]
        return margins

    def predict(self, values: np.ndarray) -> np.ndarray:
        """Value of a regression, else the index of the class; ties to the smaller index.

        Rows with the same codes go down the trees as one.
        """
        codes = self.columns.encode(values)
        different, same = self.columns.distinct(codes)
        margins = self.raise_margins(codes[different], np.tile(self.start, (len(different), 1)))[same]
        if self.kind == "regression":
            return margins[:, 0]
        return (margins[:, 0] > 0).astype("float64") if self.kind == "binary" else margins.argmax(axis=1).astype("float64")

    def to_json(self) -> str:
        about = {"kind": self.kind, "depth": self.depth, "start": self.start.tolist(), "limits": [c.tolist() for c in self.limits]}
        about["groups"] = list(self.groups)
        for name in ("feature", "limit", "gain", "leaf"):
            array = getattr(self, name)
            about[name] = [str(array.dtype), list(array.shape), base64.b64encode(array.tobytes()).decode()]
        return json.dumps(about)

    @classmethod
    def from_json(cls, text: str) -> "Forest":
        about = json.loads(text)
        arrays = [
            np.frombuffer(base64.b64decode(data), dtype).reshape(shape)
            for dtype, shape, data in (about[name] for name in ("feature", "limit", "gain", "leaf"))
        ]
        limits = [np.array(c, dtype="float64") for c in about["limits"]]
        return cls(about["kind"], np.array(about["start"], dtype="float64"), limits, about["depth"], *arrays, tuple(about.get("groups", ())))


def gradients(kind: str, margins: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss per row and class, times the rows that a row stands for.

    ``label`` is the sum of the targets in a regression, else the index of the class.
    """
    if kind == "regression":
        return weight[:, None] * margins - label[:, None], np.repeat(weight[:, None], margins.shape[1], axis=1).astype("float64")
    if kind == "binary":
        share = 1.0 / (1.0 + np.exp(-np.clip(margins, -500, 500)))
        second = share * (1 - share)
        first = share - label[:, None]
    else:
        share = np.exp(margins - margins.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        second = 2 * share * (1 - share)
        first = share - (label[:, None] == np.arange(margins.shape[1]))
    return weight[:, None] * first, weight[:, None] * np.maximum(second, 1e-16)


def best_splits(sums: np.ndarray, offsets: np.ndarray) -> pd.DataFrame:
    """The best split per node: feature (-1: none), limit, gain, and the sums left of it and in all.

    Equal gains go to the first feature and its lowest limit.
    """
    widths = np.diff(offsets)
    whole = sums[:, :, : offsets[1]].sum(axis=2)
    running = np.cumsum(sums, axis=2)
    before = np.concatenate([np.zeros((*running.shape[:2], 1)), running], axis=2)[:, :, offsets[:-1]]
    left = running - np.repeat(before, widths, axis=2)
    right = whole[:, :, None] - left

    def strength(part):
        return part[0] ** 2 / (part[1] + LEAF_PENALTY)

    gain = strength(left) + strength(right) - strength(whole)[:, None]
    allowed = (left[1] >= LEAST_WEIGHT) & (right[1] >= LEAST_WEIGHT)
    allowed[:, offsets[1:] - 1] = False  # above the last bin there is nothing
    gain = np.where(allowed, gain, -np.inf)
    top = gain.max(axis=1)
    near = gain >= (top - 1e-9 * np.maximum(1.0, np.abs(top)))[:, None]
    place = near.argmax(axis=1)
    nodes = np.arange(len(place))
    found = top > LEAST_GAIN
    feature = np.searchsorted(offsets, place, side="right") - 1
    return pd.DataFrame(
        {
            "node": nodes,
            "feature": np.where(found, feature, -1),
            "limit": np.where(found, place - offsets[feature], 0),
            "gain": np.where(found, gain[nodes, place], 0.0),
            # Without a split all rows go left.
            "left_first": np.where(found, left[0, nodes, place], whole[0]),
            "left_second": np.where(found, left[1, nodes, place], whole[1]),
            "first": whole[0],
            "second": whole[1],
        }
    )


def _apply(forest: Forest, label: int, level: int, splits: pd.DataFrame, rate: float) -> None:
    """Write the splits of one level into the newest tree of a class; the last level sets the leaves."""
    place = splits["node"].to_numpy() + 2**level - 1
    forest.feature[-1, label, place] = splits["feature"]
    forest.limit[-1, label, place] = splits["limit"]
    forest.gain[-1, label, place] = splits["gain"]
    if level == forest.depth - 1:
        left = (splits["left_first"].to_numpy(), splits["left_second"].to_numpy())
        right = (splits["first"].to_numpy() - left[0], splits["second"].to_numpy() - left[1])
        for side, (first, second) in enumerate((left, right)):
            forest.leaf[-1, label, 2 * splits["node"].to_numpy() + side] = -rate * first / (second + LEAF_PENALTY)


def _boost_here(forest: Forest, rounds: int, rate: float, codes: np.ndarray, label: np.ndarray, weight: np.ndarray) -> None:
    """All rounds over rows that one task holds."""
    columns = forest.columns
    margins = np.tile(forest.start, (len(codes), 1))
    for _ in range(rounds):
        forest.add_round()
        first, second = gradients(forest.kind, margins, label, weight)
        for c in range(len(forest.start)):
            node = np.zeros(len(codes), dtype="int64")
            for level in range(forest.depth):
                sums = columns.add_up(codes, node, 2**level, [first[:, c], second[:, c]])
                _apply(forest, c, level, best_splits(columns.by_feature(sums), columns.offsets), rate)
                node = forest.node(codes, -1, c, level + 1)
            margins[:, c] += forest.leaf[-1, c][node]


def _arrays(batch: pd.DataFrame, columns: Columns) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes = columns.read(b"".join(batch["bins"]))
    return codes, batch["label"].to_numpy(dtype="float64"), batch["weight"].to_numpy(dtype="float64")


def _binned_rows(
    df: DataFrame, features: str, label: str, limits: list[np.ndarray], kind: str, groups: tuple[int, ...] = ()
) -> DataFrame:
    """``(bins, label, weight)``: one row per different bins, and class unless it is a regression."""
    cuts = coded(df, features, Columns(limits, groups), F.col(label).cast("double").alias("label"))
    if kind == "regression":
        return cuts.groupBy("bins").agg(F.sum("label").alias("label"), F.count("*").alias("weight"))
    return cuts.groupBy("bins", "label").agg(F.count("*").alias("weight"))


def _level_splits(rows: RDD, forest: Forest, level: int, classes: list[int]) -> list[tuple[int, pd.DataFrame]]:
    """The best splits of one level of the newest trees for some classes: ``(class, splits of a node)``."""
    grown, nodes, columns = forest.since(len(forest.leaf) - 1), 2**level, forest.columns

    def sums(parts: Iterator[tuple]) -> Iterator[tuple]:
        held = {c: np.zeros((2, nodes, int(columns.starts[-1]))) for c in classes}
        for codes, label, weight, margins in parts:
            first, second = gradients(grown.kind, margins, label, weight)
            for c in classes:
                held[c] += columns.add_up(codes, grown.node(codes, 0, c, level), nodes, [first[:, c], second[:, c]])
        for c, found in held.items():
            for node in np.flatnonzero(found[1].any(axis=1)).tolist():
                yield (c, node), found[:, node]

    def choose(found: tuple) -> tuple[int, pd.DataFrame]:
        (c, node), whole = found
        return c, best_splits(columns.by_feature(whole[:, None]), columns.offsets).assign(node=node)

    tasks = min(rows.getNumPartitions(), nodes * len(classes))
    return rows.mapPartitions(sums).reduceByKey(np.add, tasks).map(choose).collect()  # one per class and node


def _boost_in_spark(table: DataFrame, path: str, forest: Forest, rounds: int, rate: float, size: int) -> None:
    """All rounds as Spark jobs, one per level, over rows that stay in the executors."""
    spark, columns, start = table.sparkSession, forest.columns, forest.start
    context, kept = spark.sparkContext, StorageLevel.MEMORY_AND_DISK

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                codes, label, weight = _arrays(batch, columns)
                parts = [np.ascontiguousarray(codes), label, weight]
                yield pd.DataFrame({n: [p.tobytes()] for n, p in zip(("bins", "label", "weight"), parts)})

    def opened(row) -> tuple[np.ndarray, ...]:
        codes, label, weight = columns.read(row["bins"]), np.frombuffer(row["label"]), np.frombuffer(row["weight"])
        return codes, label, weight, np.tile(start, (len(label), 1))

    tasks = max(context.defaultParallelism, -(-size // TASK_ROWS))
    chunks = table.repartition(tasks).mapInPandas(packed, "bins binary, label binary, weight binary")
    rows, older = chunks.rdd.map(opened).persist(kept), None
    most = max(1, HELD_SUMS // max(1, int(columns.starts[-1]) * 2 ** (forest.depth - 1)))
    every = list(range(len(forest.start)))
    groups = [every[i : i + most] for i in range(0, len(every), most)]
    for turn in range(rounds):
        if turn:
            older, rows = rows, rows.map(_raised(forest.since(turn - 1))).persist(kept)
        if turn and turn % REWRITE == 0:
            fresh = scratch_path(spark, "boosting")
            rows.saveAsPickleFile(fresh)
            older.unpersist()
            rows.unpersist()
            delete_path(spark, path)
            rows, path, older = context.pickleFile(fresh).persist(kept), fresh, None
        forest.add_round()
        for level in range(forest.depth):
            for classes in groups:
                for c, splits in _level_splits(rows, forest, level, classes):
                    _apply(forest, c, level, splits, rate)
            if older is not None:  # the first level has filled what comes after it
                older.unpersist()
                older = None
    rows.unpersist()
    delete_path(spark, path)


def _raised(newest: Forest):
    """Adds the newest trees to the margins of a chunk of rows."""

    def raised(chunk: tuple) -> tuple:
        codes, label, weight, margins = chunk
        return codes, label, weight, newest.raise_margins(codes, margins)

    return raised


def boost(
    df: DataFrame, features: str, label: str, numbers: list[str], names: int, classes: int | None,
    rounds: int, rate: float, depth: int, max_bins: int, groups: tuple[int, ...] = (),
) -> "BoostedTreesModel":
    """Fit boosted trees to ``label`` (a number, or the index of one of ``classes`` classes).

    ``features`` is a vector of ``names`` slots, the columns ``numbers`` first and flags behind;
    ``groups`` are the sizes of the last sets of flags of which at most one is set.
    An empty table gives a model that answers 0.
    """
    if not 1 <= depth <= MOST_DEPTH:
        raise ValueError(f"max_depth must lie between 1 and {MOST_DEPTH}")
    if not 2 <= max_bins <= MOST_BINS:
        raise ValueError(f"max_bins must lie between 2 and {MOST_BINS}")
    spark = df.sparkSession
    kind = "regression" if classes is None else "binary" if classes == 2 else "classes"
    limits = bin_limits(df, numbers, names - len(numbers), max_bins)
    path = scratch_path(spark, "boosting")
    _binned_rows(df, features, label, limits, kind, groups).write.parquet(path)
    table = spark.read.parquet(path)
    of_one = F.col("label") if kind == "regression" else F.col("label") * F.col("weight")
    seen = table.agg(F.count("*"), F.sum("weight"), F.sum(of_one)).first()
    mean = seen[2] / seen[1] if seen[1] else 0.0
    if kind == "binary":
        share = min(max(mean, 1e-6), 1 - 1e-6)
        start = np.array([np.log(share / (1 - share))]) if seen[1] else np.zeros(1)
    else:
        start = np.array([mean]) if kind == "regression" else np.zeros(max(1, classes))
    forest = Forest.empty(kind, start, limits, depth, groups)
    if seen[0] and seen[0] * len(forest.columns.sizes) <= LOCAL_CELLS:

        def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rows = pd.concat(list(batches), ignore_index=True)
            _boost_here(forest, rounds, rate, *_arrays(rows, forest.columns))
            yield pd.DataFrame({"forest": [forest.to_json()]})

        fitted = table.coalesce(1).mapInPandas(whole, "forest string").first()["forest"]
        delete_path(spark, path)
    else:
        if seen[0]:
            _boost_in_spark(table, path, forest, rounds, rate, seen[0])
        fitted = forest.to_json()
    return BoostedTreesModel.of(fitted, features)


class BoostedTreesModel(Model, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted trees as a stage of a pipeline; adds the value, or the index of the class."""

    fitted = Param(Params._dummy(), "fitted", "the trees as JSON text", typeConverter=TypeConverters.toString)

    @classmethod
    def of(cls, fitted: str, features: str, prediction: str = "__raw_prediction") -> "BoostedTreesModel":
        model = cls()
        model._set(fitted=fitted, featuresCol=features, predictionCol=prediction)
        return model

    @property
    def forest(self) -> Forest:
        return Forest.from_json(self.getOrDefault(self.fitted))

    @property
    def featureImportances(self) -> DenseVector:
        """Mean gain of the splits by a feature, as shares of their sum; zeros where nothing splits."""
        forest = self.forest
        used = forest.feature[forest.feature >= 0]
        gains = np.bincount(used, forest.gain[forest.feature >= 0], len(forest.limits))
        mean = gains / np.maximum(np.bincount(used, minlength=len(forest.limits)), 1)
        return Vectors.dense(mean / mean.sum() if mean.sum() > 0 else mean)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        forest = self.forest

        def predict(values: pd.Series) -> pd.Series:
            if not len(values):
                return pd.Series([], dtype="float64")
            return pd.Series(forest.predict(np.stack(values.to_numpy())))

        found = F.pandas_udf(predict, "double")(vector_to_array(self.getFeaturesCol()))
        return dataset.withColumn(self.getPredictionCol(), found)
