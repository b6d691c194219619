"""Rendezvous hashing of record keys over weighted shards.

Every key draws one number per shard and goes to the shard with the largest
draw.  A further shard adds a draw and changes none, so that keys only ever
move into the new shard.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.llm.common import add_starts, stored


def rendezvous(keys: list[Column], weights: list[float]) -> Column:
    """The shard (int from 0) of a key; shard ``i`` gets a share in proportion to ``weights[i]``.

    A null key is a key like any other.  Equal draws go to the smaller shard.
    """
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("every shard needs a positive weight")
    draws = []
    for shard, weight in enumerate(weights):
        bits = F.shiftrightunsigned(F.xxhash64(*keys, F.lit(shard)), 11)
        unit = (bits.cast("double") + 0.5) / float(1 << 53)
        draws.append(F.struct((F.lit(-float(weight)) / F.log(unit)).alias("draw"), F.lit(-shard).alias("minus")))
    return (-F.array_max(F.array(*draws))["minus"]).cast("int")


def shard_by_key(docs: DataFrame, key: str, text: str, weights: list[float]) -> DataFrame:
    """Shard and slot of every row, and its shard once another one of mean weight is added.

    Returns ``key, size, text_crc32, law, shard, slot, grown_shard``.  Size is the
    UTF-8 bytes of the text plus 1, a null text counts as empty.  Slots number the
    rows of a shard without gaps: each input partition numbers its own rows, and the
    counts of the partitions before are added, so no shard is gathered in one task
    and a key that fills a third of the rows is numbered in many.  Other columns are
    ignored; equal rows get different slots; an empty table stays empty.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    grown = [*weights, sum(weights) / len(weights)]
    placed = stored(
        docs.select(
            F.col(key).alias("key"),
            (F.octet_length(whole) + 1).cast("long").alias("size"),
            F.crc32(whole.cast("binary")).alias("text_crc32"),
            rendezvous([F.col(key)], weights).alias("shard"),
            rendezvous([F.col(key)], grown).alias("grown_shard"),
            F.spark_partition_id().alias("part"),
        ),
        "shards",
    )
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    starts = add_starts(counts, ["shard"], "part", "n", "start").drop("n")
    order = [F.xxhash64("key"), "key", "text_crc32", "size"]
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy(*order)) - 1
    return (
        placed.withColumn("place", place)
        .join(starts, ["shard", "part"])
        .select(
            F.col("key").alias(key),
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("start") + F.col("place")).cast("long").alias("slot"),
            "grown_shard",
        )
    )


def write_shards(docs: DataFrame, key: str, weights: list[float], path: str, files_per_shard: int = 1) -> None:
    """Write whole rows into folders ``shard=N``, ``files_per_shard`` files for each.

    The file of a row follows from a hash of the whole row, so a hot key spreads.
    """
    row = reduce(lambda a, b: a + b, [[F.col(f"`{c}`")] for c in docs.columns])
    part = F.pmod(F.xxhash64(*row), F.lit(files_per_shard))
    sharded = docs.withColumn("shard", rendezvous([F.col(key)], weights))
    sharded.repartition(len(weights) * files_per_shard, "shard", part).write.partitionBy("shard").parquet(path)
