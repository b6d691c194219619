"""Consecutive numbers 0..k-1 over a sorted column, without one task seeing all."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tablewright.functions import lookup
from tablewright.functions.columns import ref
from tablewright.functions.lookup import skewed_join
from tablewright.session import scratch_path


@dataclass(frozen=True)
class DenseCodes:
    """Numbers of distinct values, ready to be joined.

    ``few`` tells that the table may be broadcast; otherwise ``hot`` lists the
    values that fill a large share of the rows.
    """

    table: DataFrame
    few: bool
    hot: list[Row]

    def join(self, df: DataFrame, column: str, code: str) -> DataFrame:
        """``df`` with the number of its ``column`` as ``code``; NULL where it is missing."""
        value, number = self.table.columns
        table = self.table.withColumnsRenamed({value: column, number: code})
        if self.few:
            return df.join(F.broadcast(table), [column], "left")
        return skewed_join(df, table, [column], "left", self.hot)


def dense_codes(values: DataFrame, column: str, code: str, limit: int | None = None) -> DenseCodes:
    """Number the distinct values of ``column`` in ascending order.

    Up to ``limit`` values are sorted on the driver.  Beyond that the values are
    range-sorted by Spark and written to the shared folder, so that ids do not
    change when an executor is lost; the number of a row is its place within its
    partition plus the sizes of the partitions before it.
    """
    spark = values.sparkSession
    present = values.select(ref(column)).where(ref(column).isNotNull())
    limit = lookup.SMALL_ROWS if limit is None else limit
    # The sketch saves counting the values exactly when there are far too many.
    about = present.agg(F.approx_count_distinct(ref(column)).alias("n")).first()["n"]
    rows = lookup.small_rows(present.distinct(), limit) if about <= 2 * limit else None
    if rows is not None:
        ordered = sorted(row[0] for row in rows)
        schema = present.schema.add(code, "long")
        return DenseCodes(spark.createDataFrame([(v, i) for i, v in enumerate(ordered)], schema), True, [])

    path = scratch_path(spark, "codes")
    counted = present.groupBy(ref(column)).agg(F.count("*").alias("__copies"))
    counted.sort(ref(column)).withColumn("__id", F.monotonically_increasing_id()).write.parquet(path)
    stored = spark.read.parquet(path)
    part = F.shiftright("__id", 33)
    sizes = stored.groupBy(part.alias("__part")).agg(F.count("*").alias("n"), F.sum("__copies").alias("copies"))
    offsets, start, total = [], 0, 0
    for row in sizes.orderBy("__part").collect():  # one row per partition
        offsets.append((row["__part"], start))
        start, total = start + row["n"], total + row["copies"]
    starts = F.broadcast(spark.createDataFrame(offsets, "__part long, __start long"))
    place = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = stored.withColumn("__part", part).join(starts, "__part")
    often = F.col("__copies") * lookup.HOT_SHARE > total
    hot = stored.where(often & lookup.little_text(stored, [column])).select(ref(column)).collect()
    return DenseCodes(numbered.select(ref(column), (F.col("__start") + place).alias(code)), False, hot)
