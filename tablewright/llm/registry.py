"""Queries and SQL of this subpackage for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tablewright.llm import queries as own

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return own.QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(own.SQL)
