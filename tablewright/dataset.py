"""The four versions of a table that an analysis works with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from tablewright.operators.filters import Filter, apply_filters
from tablewright.sources import store

Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Dataset:
    """Immutable handle: ``base``, ``clean``, ``filtered`` and ``model``.

    All four are lazy DataFrames on one lineage; no step runs a job by itself.
    """

    base: DataFrame
    clean: DataFrame
    filtered: DataFrame
    model: DataFrame

    @staticmethod
    def of(df: DataFrame) -> Dataset:
        """A fresh table: all versions are the same."""
        return Dataset(df, df, df, df)

    def cleaned(self, step: Step) -> Dataset:
        """Clean the table.  Filters and features start over from the result."""
        table = step(self.clean)
        return Dataset(table, table, table, table)

    def filter(
        self, filters: list[Filter], sql: str | None = None, on_error: str = "raise", nan_as_null: bool = True
    ) -> Dataset:
        """Filter the cleaned table; features start over from the result."""
        kept = apply_filters(self.clean, filters, sql, on_error, nan_as_null)
        return replace(self, filtered=kept, model=kept)

    def reset_filters(self) -> Dataset:
        return replace(self, filtered=self.clean, model=self.clean)

    def save(self, root: str, name: str) -> str:
        """Keep the cleaned table for later sessions."""
        return store.save_table(self.clean, root, name)

    @staticmethod
    def restore(spark: SparkSession, root: str, name: str) -> Dataset | None:
        """The table kept under that name, or None."""
        table = store.load_table(spark, root, name)
        return None if table is None else Dataset.of(table)

    def engineered(self, step: Step) -> Dataset:
        """Change the feature table only."""
        return replace(self, model=step(self.model))
