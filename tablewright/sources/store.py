"""Named tables that outlive a session, as versioned Parquet folders.

A save writes a new version and never touches the one that may be being read;
a version counts once Spark has marked it complete.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

KEPT_VERSIONS = 2
CHARTS = "charts"


def save_table(df: DataFrame, root: str, name: str, partition_by: list[str] | None = None) -> str:
    """Write ``df`` as the newest version of ``name``; returns its path.

    The version before it stays for readers that still use it.
    """
    spark = df.sparkSession
    path = f"{root}/{name}/v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    for old in _versions(spark, root, name)[:-KEPT_VERSIONS]:
        _delete(spark, old)
    return path


def load_table(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """The newest complete version, or None when there is none that can be read."""
    versions = _versions(spark, root, name)
    if not versions:
        return None
    try:
        return spark.read.parquet(versions[-1])
    except PySparkException:
        return None


def delete_table(spark: SparkSession, root: str, name: str) -> None:
    """Forget a table; an absent one is no error."""
    _delete(spark, f"{root}/{name}")


def table_names(spark: SparkSession, root: str) -> list[str]:
    """Names that have a complete version."""
    return [n for n in _children(spark, root) if _versions(spark, root, n)]


def save_chart(data: DataFrame, root: str, name: str) -> str:
    """Keep the data of a chart under a name."""
    return save_table(data, f"{root}/{CHARTS}", name)


def load_chart(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    return load_table(spark, f"{root}/{CHARTS}", name)


def remove_chart(spark: SparkSession, root: str, name: str) -> None:
    delete_table(spark, f"{root}/{CHARTS}", name)


def chart_names(spark: SparkSession, root: str) -> list[str]:
    return table_names(spark, f"{root}/{CHARTS}")


def _folder(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _children(spark: SparkSession, path: str) -> list[str]:
    files, folder = _folder(spark, path)
    if not files.exists(folder):
        return []
    return sorted(status.getPath().getName() for status in files.listStatus(folder))


def _versions(spark: SparkSession, root: str, name: str) -> list[str]:
    base = f"{root}/{name}"
    return [f"{base}/{v}" for v in _children(spark, base) if "_SUCCESS" in _children(spark, f"{base}/{v}")]


def _delete(spark: SparkSession, path: str) -> None:
    files, folder = _folder(spark, path)
    files.delete(folder, True)
