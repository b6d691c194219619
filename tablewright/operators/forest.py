"""Random forests grown from bootstrap sums of binned rows.

Each tree draws every row a Poisson(1) number of times, as Spark's own forests do.  The
draws of all trees are made where a row lies: rows with the same codes become one cell
with the sums of their draws, so a task keeps no more than the cells it has met.  Where
rows differ too much for that, they stay as they are with the seed of their draws.  Then
each level of all trees is one job: tasks sum per (tree, node, column, code), Spark merges
the sums per tree, and the chosen splits come back.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark import TaskContext
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

from tablewright.operators.treebins import Columns, bin_limits

#: Trees are kept as complete ones; deeper forests are those of Spark ML.
MOST_DEPTH = 12
#: Rows that draw together, and how many of them a cell has to stand for to be kept instead.
CHUNK_ROWS, ROWS_A_CELL = 1 << 18, 16
#: Cells of a task that are kept together.
MOST_CELLS = 1 << 15
#: Sums that a task holds at a time.
HELD_SUMS = 4_000_000


@dataclass
class Trees:
    """Grown trees ``[tree, node]``, level by level; ``leaf`` holds means, or shares of the classes."""

    classes: int  # 0: regression
    limits: list[np.ndarray]
    groups: tuple[int, ...]
    depth: int
    feature: np.ndarray
    limit: np.ndarray
    gain: np.ndarray
    leaf: np.ndarray

    @cached_property
    def columns(self) -> Columns:
        return Columns(self.limits, self.groups)

    def predict(self, values: np.ndarray) -> np.ndarray:
        """Mean of the trees, or the class with the largest sum of shares; ties to the smaller index."""
        codes = self.columns.encode(values)
        different, same = self.columns.distinct(codes)
        codes = codes[different]
        votes = np.zeros((len(codes), self.leaf.shape[2]))
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf):
            votes += leaf[self.columns.walk(codes, feature, limit, self.depth)]
        votes /= max(1, len(self.leaf))
        return (votes.argmax(axis=1).astype("float64") if self.classes else votes[:, 0])[same]

    def to_json(self) -> str:
        about = {"classes": self.classes, "depth": self.depth, "groups": list(self.groups), "limits": [c.tolist() for c in self.limits]}
        for name in ("feature", "limit", "gain", "leaf"):
            array = getattr(self, name)
            about[name] = [str(array.dtype), list(array.shape), base64.b64encode(array.tobytes()).decode()]
        return json.dumps(about)

    @classmethod
    def from_json(cls, text: str) -> "Trees":
        about = json.loads(text)
        arrays = [
            np.frombuffer(base64.b64decode(data), dtype).reshape(shape)
            for dtype, shape, data in (about[name] for name in ("feature", "limit", "gain", "leaf"))
        ]
        limits = [np.array(c, dtype="float64") for c in about["limits"]]
        return cls(about["classes"], limits, tuple(about["groups"]), about["depth"], *arrays)


def _poisson_table() -> tuple[np.ndarray, np.ndarray]:
    """Chances of at most 0, 1, ... draws, and the draws of each 65536th of the chances; -1 where it holds a limit."""
    most = np.cumsum(np.exp(-1.0) / np.concatenate([[1.0], np.cumprod(np.arange(1.0, 18.0))]))
    low, high = (np.searchsorted(most, np.arange(1 << 16) / 65536 + d, side="right") for d in (0.0, 1 / 65536))
    return most, np.where(low == high, low, -1).astype("float64")


_MOST, _DRAWN = _poisson_table()


def draws(seed: list[int], tree: int, rows: int) -> np.ndarray:
    """How often a tree takes each row: Poisson numbers of mean 1 that follow from the seed."""
    rng = np.random.default_rng([*seed, tree])
    place = rng.integers(0, 1 << 16, rows, dtype="uint16")
    drawn = _DRAWN[place]
    open_ = np.flatnonzero(drawn < 0)
    drawn[open_] = np.searchsorted(_MOST, (place[open_] + rng.random(len(open_))) / 65536, side="right")
    return drawn


@dataclass
class Cells:
    """Rows with the same codes (and class): draws per tree, and in a regression their sums of the target.

    With a ``seed`` these are single rows, whose draws are made again when they are needed.
    """

    codes: np.ndarray
    label: np.ndarray
    drawn: np.ndarray | None = None
    summed: np.ndarray | None = None
    seed: list[int] | None = None

    def of_tree(self, tree: int, classes: int) -> list[np.ndarray]:
        if self.seed is None:
            return [self.drawn[tree]] if classes else [self.drawn[tree], self.summed[tree]]
        drawn = draws(self.seed, tree, len(self.codes))
        return [drawn] if classes else [drawn, drawn * self.label]


def _alike(columns: Columns, codes: np.ndarray, label: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the different cells, and the cell of each row."""
    first, back = columns.distinct(codes)
    if not classes:
        return first, back
    _, place, whole = np.unique(back * classes + label.astype("int64"), return_index=True, return_inverse=True)
    return place, whole.ravel()


def _condensed(columns: Columns, rows: Cells, trees: int, classes: int) -> Cells:
    """Single rows as cells, where these are few."""
    first, back = _alike(columns, rows.codes, rows.label, classes)
    if len(first) * ROWS_A_CELL > len(back) or len(first) > MOST_CELLS:
        return rows
    sums = [np.empty((trees, len(first))) for _ in range(1 if classes else 2)]
    for tree in range(trees):
        for total, value in zip(sums, rows.of_tree(tree, classes)):
            total[tree] = np.bincount(back, value, len(first))
    return Cells(np.asfortranarray(rows.codes[first]), rows.label[first], *sums)


def _merged(columns: Columns, one: Cells, other: Cells, classes: int) -> Cells | None:
    """The cells of both; None where they are too many."""
    codes, label = np.concatenate([one.codes, other.codes]), np.concatenate([one.label, other.label])
    first, back = _alike(columns, codes, label, classes)
    if len(first) > MOST_CELLS:
        return None
    parts = [(one.drawn, other.drawn)] if classes else [(one.drawn, other.drawn), (one.summed, other.summed)]
    sums = [np.stack([np.bincount(back, v, len(first)) for v in np.concatenate(p, axis=1)]) for p in parts]
    return Cells(np.asfortranarray(codes[first]), label[first], *sums)


def _cells(df: DataFrame, features: str, label: str, centre: float, columns: Columns, trees: int, classes: int, seed: int) -> RDD:
    """All rows as ``Cells``."""

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                codes = np.ascontiguousarray(columns.encode(np.stack(batch["values"].to_numpy())))
                target = batch["label"].to_numpy(dtype="float64") - centre
                yield pd.DataFrame({"codes": [codes.tobytes()], "label": [target.tobytes()]})

    def gathered(parts: Iterator) -> Iterator[Cells]:
        held, codes, label, chunk = None, [], [], 0

        def drawn() -> Cells:
            rows = Cells(np.asfortranarray(np.concatenate(codes)), np.concatenate(label))
            rows.seed = [seed, TaskContext.get().partitionId(), chunk]
            return _condensed(columns, rows, trees, classes)

        def add(new: Cells) -> Iterator[Cells]:
            nonlocal held
            if new.seed is not None:
                yield new
                return
            both = new if held is None else _merged(columns, held, new, classes)
            if both is None:
                yield held
            held = new if both is None else both

        for part in parts:
            codes.append(columns.read(part["codes"]))
            label.append(np.frombuffer(part["label"]))
            if sum(map(len, label)) >= CHUNK_ROWS:
                yield from add(drawn())
                codes, label, chunk = [], [], chunk + 1
        if label:
            yield from add(drawn())
        if held is not None:
            yield held

    source = df.select(vector_to_array(features).alias("values"), F.col(label).cast("double").alias("label"))
    return source.mapInPandas(packed, "codes binary, label binary").rdd.mapPartitions(gathered)


def best_splits(sums: np.ndarray, columns: Columns, classes: int, tried: np.ndarray) -> pd.DataFrame:
    """The best split per node among the features that it tries, and the sums left of it and in all.

    ``sums`` is ``[node, value, code]``: draws and target of a regression, else draws per class.
    """
    offsets, widths = columns.offsets, np.diff(columns.offsets)
    full = columns.by_feature(sums)
    whole = full[:, :, : offsets[1]].sum(axis=2)
    running = np.cumsum(full, axis=2)
    before = np.concatenate([np.zeros((*running.shape[:2], 1)), running], axis=2)[:, :, offsets[:-1]]
    left = running - np.repeat(before, widths, axis=2)
    right = whole[:, :, None] - left

    def weight(part):
        return part.sum(axis=1) if classes else part[:, 0]

    def strength(part):
        value = (part**2).sum(axis=1) if classes else part[:, 1] ** 2
        return value / np.maximum(weight(part), 1.0)

    both = strength(left) + strength(right)
    gain = both - strength(whole)[:, None]
    # Draws are whole numbers; sums of flags are taken off others and may miss them by a rounding.
    allowed = (weight(left) > 0.5) & (weight(right) > 0.5) & (gain > 1e-12 * both) & np.repeat(tried, widths, axis=1)
    allowed[:, offsets[1:] - 1] = False
    gain = np.where(allowed, gain, -np.inf)
    top = gain.max(axis=1)
    found = top > 0
    place = (gain >= (top - 1e-9 * np.abs(np.where(found, top, 0)))[:, None]).argmax(axis=1)
    nodes = np.arange(len(place))
    feature = np.searchsorted(offsets, place, side="right") - 1
    return pd.DataFrame(
        {
            "feature": np.where(found, feature, -1),
            "limit": np.where(found, place - offsets[feature], 0),
            "gain": np.where(found, top, 0.0),
            "left": list(np.where(found[:, None], left[nodes, :, place], whole)),
            "whole": list(whole),
        }
    )


def _level(cells: RDD, trees: Trees, level: int, seed: int) -> list[tuple[int, pd.DataFrame]]:
    """``(tree, splits of the nodes of one level)`` of every tree."""
    columns, classes, nodes, number = trees.columns, trees.classes, 2**level, len(trees.feature)
    values, total = classes or 2, int(columns.starts[-1])
    most = max(1, HELD_SUMS // (nodes * values * total))
    features = len(trees.limits)
    few = -(-features // 3) if not classes else int(np.ceil(np.sqrt(features)))
    few = features if number == 1 else few

    def sums(parts: Iterator[Cells]) -> Iterator[tuple[int, np.ndarray]]:
        kept = list(parts)
        for low in range(0, number if kept else 0, most):
            for tree in range(low, min(number, low + most)):
                held = np.zeros((values, nodes, total))
                for c in kept:
                    node = columns.walk(c.codes, trees.feature[tree], trees.limit[tree], level)
                    own = c.of_tree(tree, classes)
                    if classes:  # a node per class
                        found = columns.add_up(c.codes, node * classes + c.label.astype("int64"), nodes * classes, own)
                        held += found[0].reshape(nodes, classes, total).swapaxes(0, 1)
                    else:
                        held += columns.add_up(c.codes, node, nodes, own)
                yield tree, held.swapaxes(0, 1)

    def choose(found: tuple[int, np.ndarray]) -> tuple[int, pd.DataFrame]:
        tree, whole = found
        order = np.random.default_rng([seed, tree, level]).random((nodes, features)).argsort(axis=1)
        return tree, best_splits(whole, columns, classes, order.argsort(axis=1) < few)

    return cells.mapPartitions(sums).reduceByKey(np.add, min(number, max(1, cells.getNumPartitions()))).map(choose).collect()


def grow(
    df: DataFrame, features: str, label: str, numbers: list[str], names: int, classes: int | None,
    count: int, depth: int, max_bins: int, groups: tuple[int, ...], seed: int,
) -> "GrownForestModel":
    """A forest of ``count`` trees for ``label``: a number, or the index of one of ``classes`` classes.

    A node tries a third of the features in a regression, else as many as the square root of their number.
    """
    limits = bin_limits(df, numbers, names - len(numbers), max_bins)
    kinds = classes or 0
    centre = 0.0 if kinds else float(df.agg(F.avg(label)).first()[0] or 0.0)
    inner = (count, 2**depth - 1)
    trees = Trees(
        kinds, limits, groups, depth, np.full(inner, -1, "int32"), np.zeros(inner, "int32"), np.zeros(inner),
        np.zeros((count, 2**depth, kinds or 1)),
    )
    cells = _cells(df, features, label, centre, trees.columns, count, kinds, seed).persist(StorageLevel.MEMORY_AND_DISK)
    for level in range(depth):
        for tree, splits in _level(cells, trees, level, seed):
            place = slice(2**level - 1, 2 ** (level + 1) - 1)
            trees.feature[tree, place], trees.limit[tree, place] = splits["feature"], splits["limit"]
            trees.gain[tree, place] = splits["gain"]
            if level == depth - 1:
                left, whole = np.stack(splits["left"]), np.stack(splits["whole"])
                ends = np.stack([left, whole - left], axis=1).reshape(2**depth, -1)
                if kinds:
                    trees.leaf[tree] = ends / np.maximum(ends.sum(axis=1, keepdims=True), 1.0)
                else:
                    trees.leaf[tree, :, 0] = centre + ends[:, 1] / np.maximum(ends[:, 0], 1.0)
    cells.unpersist()
    return GrownForestModel.of(trees.to_json(), features)


@dataclass(frozen=True)
class GrownTree:
    """One tree, as far as it is asked for."""

    depth: int


class GrownForestModel(Model, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Grown trees as a stage of a pipeline; adds the value, or the index of the class."""

    fitted = Param(Params._dummy(), "fitted", "the trees as JSON text", typeConverter=TypeConverters.toString)

    @classmethod
    def of(cls, fitted: str, features: str, prediction: str = "__raw_prediction") -> "GrownForestModel":
        model = cls()
        model._set(fitted=fitted, featuresCol=features, predictionCol=prediction)
        return model

    @property
    def forest(self) -> Trees:
        return Trees.from_json(self.getOrDefault(self.fitted))

    @property
    def trees(self) -> list[GrownTree]:
        """Depth of each tree: levels down to its lowest split."""
        found = self.forest.feature >= 0
        return [GrownTree(int(np.flatnonzero(f).max(initial=-1) + 1).bit_length()) for f in found]

    @property
    def featureImportances(self) -> DenseVector:
        """Gains of the splits by a feature, as shares per tree, summed and made shares again."""
        forest = self.forest
        total = np.zeros(len(forest.limits))
        for feature, gain in zip(forest.feature, forest.gain):
            own = np.bincount(feature[feature >= 0], gain[feature >= 0], len(total))
            total += own / own.sum() if own.sum() > 0 else own
        return Vectors.dense(total / total.sum() if total.sum() > 0 else total)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        forest = self.forest

        def predict(values: pd.Series) -> pd.Series:
            if not len(values):
                return pd.Series([], dtype="float64")
            return pd.Series(forest.predict(np.stack(values.to_numpy())))

        found = F.pandas_udf(predict, "double")(vector_to_array(self.getFeaturesCol()))
        return dataset.withColumn(self.getPredictionCol(), found)
