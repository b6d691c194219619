"""Binned features for trees: limits, codes, sums per code, and the way of rows down a tree.

A number has a column of codes, one code per bin.  Flags of which at most one is set, as
those of one text column, share a column: code 0 stands for none of them, ``j + 1`` for the
flag ``j``.  So a row has as many codes as the table has columns, however many flags.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.reports import statistics

#: Rank error of the bin limits is one in this many rows.
CUT_ACCURACY = 10_000


def bin_limits(df: DataFrame, numbers: list[str], flags: int, max_bins: int) -> list[np.ndarray]:
    """Ascending limits per feature: quantiles of the number columns, then 0.5 for each flag.

    The bin of a value is the number of limits that are not above it.  A column with few
    values, each in a fair share of the rows, has a bin for each of them.
    """
    ranks = [i / (max_bins - 1) for i in range(max_bins)]
    found = statistics(df, {c: F.percentile_approx(c, ranks, CUT_ACCURACY) for c in numbers}) if numbers else {}
    limits = [np.unique(np.array(found[c] or [], dtype="float64"))[1:] for c in numbers]
    return limits + [np.array([0.5])] * flags


@dataclass(frozen=True)
class Columns:
    """How the features lie in columns of codes; ``groups`` are the sizes of the last sets of flags."""

    limits: list[np.ndarray]
    groups: tuple[int, ...] = ()

    @cached_property
    def numbers(self) -> int:
        """Features with a column of their own."""
        return len(self.limits) - sum(self.groups)

    @cached_property
    def sizes(self) -> np.ndarray:
        """Codes per column."""
        return np.array([*[len(c) + 1 for c in self.limits[: self.numbers]], *[g + 1 for g in self.groups]], dtype="int64")

    @cached_property
    def starts(self) -> np.ndarray:
        """Where the codes of each column begin in a row of sums; the last is their number."""
        return np.concatenate([[0], np.cumsum(self.sizes)]).astype("int64")

    @cached_property
    def dtype(self) -> np.dtype:
        return np.min_scalar_type(int(self.sizes.max(initial=1)) - 1)

    @cached_property
    def offsets(self) -> np.ndarray:
        """Where the bins of each feature begin in sums per feature; the last is their number."""
        return np.concatenate([[0], np.cumsum([len(c) + 1 for c in self.limits])]).astype("int64")

    def encode(self, values: np.ndarray) -> np.ndarray:
        """The codes of rows of feature values, column by column in memory."""
        codes = np.empty((len(values), len(self.sizes)), dtype=self.dtype, order="F")
        for i, cuts in enumerate(self.limits[: self.numbers]):
            codes[:, i] = np.searchsorted(cuts, values[:, i], side="right")
        low = self.numbers
        for i, size in enumerate(self.groups):
            is_set = values[:, low : low + size] >= 0.5
            codes[:, self.numbers + i] = np.where(is_set.any(axis=1), is_set.argmax(axis=1) + 1, 0)
            low += size
        return codes

    def read(self, data: bytes) -> np.ndarray:
        """Codes of rows that stand one behind the other in ``data``."""
        return np.asfortranarray(np.frombuffer(data, dtype=self.dtype).reshape(-1, len(self.sizes)))

    def distinct(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the different rows, and for each row which of them it equals."""
        if np.prod(self.sizes.astype("float64")) < 2**62:
            scale = np.concatenate([[1], np.cumprod(self.sizes[:-1])]) if len(self.sizes) else np.empty(0, "int64")
            keys = np.zeros(len(codes), dtype="int64")
            for i, s in enumerate(scale):
                keys += codes[:, i].astype("int64") * s
        else:
            whole = np.ascontiguousarray(codes)
            keys = whole.view(np.dtype((np.void, whole.dtype.itemsize * whole.shape[1]))).ravel()
        _, first, back = np.unique(keys, return_index=True, return_inverse=True)
        return first, back.ravel()

    def add_up(self, codes: np.ndarray, node: np.ndarray, nodes: int, values: list[np.ndarray]) -> np.ndarray:
        """Sums of each of ``values`` as ``[value, node, code of all columns]``."""
        sums = np.empty((len(values), nodes, int(self.starts[-1])))
        for i, size in enumerate(self.sizes.tolist()):
            place = node * size + codes[:, i]
            for v, value in enumerate(values):
                found = np.bincount(place, value, nodes * size)
                sums[v, :, self.starts[i] : self.starts[i + 1]] = found.reshape(nodes, size)
        return sums

    def by_feature(self, sums: np.ndarray) -> np.ndarray:
        """Sums per code (the last axis) as sums per bin of every feature."""
        parts = [sums[..., : self.starts[self.numbers]]]
        for i, size in enumerate(self.groups, self.numbers):
            codes = sums[..., self.starts[i] : self.starts[i + 1]]
            flag = codes[..., 1:]
            both = np.stack([codes.sum(axis=-1, keepdims=True) - flag, flag], axis=-1)
            parts.append(both.reshape(*flag.shape[:-1], 2 * size))
        return np.concatenate(parts, axis=-1)

    def walk(self, codes: np.ndarray, feature: np.ndarray, limit: np.ndarray, levels: int) -> np.ndarray:
        """The node of each row after ``levels`` levels of a complete tree; without a split all go left."""
        node = np.zeros(len(codes), dtype="int64")
        rows = np.arange(len(codes))
        inner = feature[: 2**levels - 1]
        column, low, high = (self._tests[i][inner] for i in range(3))
        low = np.where(inner < self.numbers, limit[: len(inner)], low)
        for level in range(levels):
            first = 2**level - 1
            own = inner[first : 2 * first + 1]
            if (own < 0).all():
                node = 2 * node
                continue
            place = node + first
            code = codes[rows, column[place]] if level else codes[:, column[0]]
            node = 2 * node + ((code > low[place]) & (code <= high[place]) & (inner[place] >= 0))
        return node

    @cached_property
    def _tests(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Column of each feature, and the codes between which (low excluded) a row goes right."""
        most = np.iinfo("int64").max
        column, low, high = list(range(self.numbers)), [0] * self.numbers, [most] * self.numbers
        for i, size in enumerate(self.groups, self.numbers):
            column += [i] * size
            low += range(size)
            high += range(1, size + 1)
        return tuple(np.array(part, dtype="int64") for part in (column, low, high))


def coded(df: DataFrame, features: str, columns: Columns, *others) -> DataFrame:
    """``bins`` (the codes of a row in bytes) and the double column ``label`` of every row."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                codes = np.ascontiguousarray(columns.encode(np.stack(batch["values"].to_numpy())))
                yield pd.DataFrame({"bins": [row.tobytes() for row in codes], "label": batch["label"]})

    return df.select(vector_to_array(features).alias("values"), *others).mapInPandas(cut, "bins binary, label double")
