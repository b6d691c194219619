"""Helpers that several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.session import scratch_path

#: A word is a run of anything but space and the five ASCII control blanks.
WORD = r"[^\x20\x09-\x0D]+"
BREAK = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"

PARTS_PER_BLOCK = 1024


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer file is; every machine has the same Python packages."""
    import public_tokenizers

    return public_tokenizers.path(name)


def values_of(column, rows: int = 256):
    """The values of an Arrow column one by one; only ``rows`` of them are Python objects at a time."""
    for low in range(0, len(column), rows):
        yield from column.slice(low, rows).to_pylist()


def words_of(text: Column) -> Column:
    """The words of a text as an array; none for a null or blank text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BREAK))


def count_words(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def add_starts(
    parts: DataFrame, keys: list[str], order: str, amount: str, start: str, per_block: int = PARTS_PER_BLOCK
) -> DataFrame:
    """``parts`` with the sum of ``amount`` over all rows of the same keys with a smaller ``order``.

    ``order`` is a non-negative whole number, unique within ``keys``.  Sums run over
    blocks of ``per_block`` numbers and then inside each block, so that even a million
    parts need only a thousand rows in one task.
    """
    block = "__block"
    blocked = parts.withColumn(block, F.floor(F.col(order) / per_block))
    sums = blocked.groupBy(*keys, block).agg(F.sum(amount).alias("__sum"))
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, block, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*keys, block).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    within = blocked.withColumn("__within", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    joined = within.join(sums, [*keys, block])
    return joined.withColumn(start, F.col("__before") + F.col("__within")).drop(block, "__before", "__within")
