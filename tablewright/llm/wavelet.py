"""Token ids of a shard as a wavelet matrix: one bit-plane per bit, with rank and select.

A plane holds one bit of every token; below it, the tokens whose bit is 0 come
first and those with a 1 after them, each in order.  Access, counting and the
lookup of occurrences then need one rank or select per plane.  A shard is one row
of a Parquet file whose binary columns are compressed, so any store that Spark
reaches can hold it.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import add_starts, stored
from tablewright.llm.tokens import encode_documents

#: Bits between two entries of the rank directory.
RANK_BITS = 512
#: A shard ends after the document that brings it to this many tokens.
SHARD_TOKENS = 1 << 20
#: Bytes of text per range partition.
PARTITION_BYTES = 24 << 20
_MOST_SHARDS = 1 << 16  # of one partition

SHARD_SCHEMA = (
    "shard long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, "
    "zeros array<long>, planes array<binary>, ranks array<binary>"
)
DOC_SCHEMA = "doc_id long, shard long, shard_start long, n_tokens long, ids_crc32 long"


class WaveletMatrix:
    """A sequence of unsigned ids with access, rank and select."""

    def __init__(self, n: int, zeros: list[int], planes: list[bytes], ranks: list[bytes]) -> None:
        self.n, self.zeros = n, zeros
        self.planes = [np.frombuffer(p, np.uint8) for p in planes]
        self.ranks = [np.frombuffer(r, "<u4") for r in ranks]

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        width = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        rest, zeros, planes, ranks = ids.astype(np.uint16 if width <= 16 else np.uint32), [], [], []
        for level in range(width - 1, -1, -1):
            bits = (rest & (1 << level)) != 0
            packed = np.packbits(bits)
            planes.append(packed.tobytes())
            starts = np.arange(0, len(packed), RANK_BITS // 8)
            ones = np.add.reduceat(np.bitwise_count(packed).astype(np.uint32), starts) if len(packed) else starts
            ranks.append((np.cumsum(ones) - ones).astype("<u4").tobytes())
            zero = rest[~bits]
            zeros.append(len(zero))
            rest = np.concatenate([zero, rest[bits]])
        return cls(len(ids), zeros, planes, ranks)

    def parts(self) -> tuple[list[int], list[bytes], list[bytes]]:
        return self.zeros, [p.tobytes() for p in self.planes], [r.tobytes() for r in self.ranks]

    def _ones(self, level: int, end: int) -> int:
        """Ones among the first ``end`` bits of a plane."""
        if end <= 0:
            return 0
        block = min(end // RANK_BITS, len(self.ranks[level]) - 1)
        first = block * (RANK_BITS // 8)
        full, more = divmod(end - block * RANK_BITS, 8)
        found = int(self.ranks[level][block]) + int(np.bitwise_count(self.planes[level][first : first + full]).sum())
        return found + (int(self.planes[level][first + full]) >> (8 - more)).bit_count() if more else found

    def _bit(self, level: int, at: int) -> int:
        return int(self.planes[level][at // 8]) >> (7 - at % 8) & 1

    def access(self, at: int) -> int:
        """The id at a place."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for level, zeros in enumerate(self.zeros):
            bit, ones = self._bit(level, at), self._ones(level, at)
            value, at = value << 1 | bit, zeros + ones if bit else at - ones
        return value

    def _range(self, symbol: int, low: int, high: int) -> tuple[int, int]:
        if symbol >> len(self.zeros):
            return 0, 0
        for level, zeros in enumerate(self.zeros):
            a, b = self._ones(level, low), self._ones(level, high)
            one = symbol >> (len(self.zeros) - 1 - level) & 1
            low, high = (zeros + a, zeros + b) if one else (low - a, high - b)
        return low, high

    def rank(self, symbol: int, end: int) -> int:
        """How often an id stands among the first ``end`` tokens."""
        low, high = self._range(symbol, 0, min(max(end, 0), self.n))
        return high - low

    def count(self, symbol: int, low: int, high: int) -> int:
        return max(0, self.rank(symbol, high) - self.rank(symbol, low))

    def select(self, symbol: int, number: int) -> int:
        """The place of occurrence ``number`` (from 0) of an id, -1 if there are not so many."""
        low, high = self._range(symbol, 0, self.n)
        if not 0 <= number < high - low:
            return -1
        at = low + number
        for level in range(len(self.zeros) - 1, -1, -1):
            one = symbol >> (len(self.zeros) - 1 - level) & 1
            wanted = at - self.zeros[level] if one else at
            left, right = 0, self.n - 1  # the place of the wanted bit
            while left < right:
                middle = (left + right) // 2
                ones = self._ones(level, middle + 1)
                if (ones if one else middle + 1 - ones) > wanted:
                    right = middle
                else:
                    left = middle + 1
            at = left
        return at

    def places(self, symbol: int) -> np.ndarray:
        """All places of an id in ascending order: its range below the last plane, carried up."""
        low, high = self._range(symbol, 0, self.n)
        at = np.arange(low, high)
        for level in range(len(self.zeros) - 1, -1, -1):
            if not len(at):
                break
            bits = np.unpackbits(self.planes[level], count=self.n).view(bool)
            one = symbol >> (len(self.zeros) - 1 - level) & 1
            at = np.flatnonzero(bits)[at - self.zeros[level]] if one else np.flatnonzero(~bits)[at]
        return at

    def decode(self) -> np.ndarray:
        """All ids in order: the planes are undone from the lowest bit up."""
        values = np.zeros(self.n, np.uint16 if len(self.zeros) <= 16 else np.uint32)
        for level in range(len(self.zeros) - 1, -1, -1):
            bits = np.unpackbits(self.planes[level], count=self.n).view(bool)
            above = np.empty_like(values)
            above[~bits] = values[: self.zeros[level]]
            above[bits] = values[self.zeros[level] :] | (1 << (len(self.zeros) - 1 - level))
            values = above
        return values


def write_token_shards(docs: DataFrame, key: str, text: str, tokenizer: str, end_id: int, path: str) -> None:
    """Encode all texts and write them as shards, in ascending key order (null first).

    ``tokenizer`` names a tokenizer file that every executor has.  A null text has only
    the end id.  Rows of one key stand next to each other; as the row's place in the
    input is a second sort key, a key that fills a third of the rows fills several
    partitions.  Other columns are ignored, an empty table writes no shard.
    """
    size = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    partitions = max(1, -(-size // PARTITION_BYTES), docs.sparkSession.sparkContext.defaultParallelism)
    rows = docs.select(
        F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row")
    )
    ordered = rows.repartitionByRange(partitions, "key", "row").sortWithinPartitions("key", "row")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, keys, parts, total = TaskContext.get().partitionId() * _MOST_SHARDS, [], [], 0
        for batch in batches:
            names = batch.column("key").to_pylist()
            for row, ids in encode_documents(tokenizer, end_id, batch.column("text")):
                keys.append(names[row])
                parts.append(ids)
                total += len(ids)
                if total >= SHARD_TOKENS:
                    yield shard_row(number, keys, parts)
                    number, keys, parts, total = number + 1, [], [], 0
        if parts:
            yield shard_row(number, keys, parts)

    ordered.select("key", "text").mapInArrow(encode, SHARD_SCHEMA).write.option("compression", "zstd").parquet(path)


def shard_row(number: int, keys: list[int | None], parts: list[np.ndarray]) -> pa.RecordBatch:
    ids = np.concatenate(parts)
    zeros, planes, ranks = WaveletMatrix.build(ids).parts()
    row = [number, len(ids), keys, [len(p) for p in parts], zeros, planes, ranks]
    kinds = [pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3, *[pa.list_(pa.binary())] * 2]
    names = ["shard", "n_tokens", "doc_ids", "doc_tokens", "zeros", "planes", "ranks"]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)


def read_token_shards(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, from the files alone: ``doc_id, start, n_tokens, ids_crc32, shard``.

    ``start`` counts the ids of all documents before it, over all shards.
    """
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    sizes = shards.select("shard", "n_tokens")
    starts = add_starts(sizes, [], "shard", "n_tokens", "before", _MOST_SHARDS * 1024).drop("n_tokens")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch.column(name)[at].as_py() for name in batch.schema.names}
                ids = WaveletMatrix(row["n_tokens"], row["zeros"], row["planes"], []).decode().astype("<u4")
                ends = np.cumsum(row["doc_tokens"])
                begins = ends - row["doc_tokens"]
                sums = [crc32(ids[a:b]) for a, b in zip(begins.tolist(), ends.tolist())]
                columns = [row["doc_ids"], [row["shard"]] * len(sums), begins, row["doc_tokens"], sums]
                names = ["doc_id", "shard", "shard_start", "n_tokens", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    docs = shards.select("shard", "n_tokens", "doc_ids", "doc_tokens", "zeros", "planes").mapInArrow(decode, DOC_SCHEMA)
    return docs.join(stored(starts, "starts"), "shard").select(
        "doc_id", (F.col("before") + F.col("shard_start")).cast("long").alias("start"), "n_tokens", "ids_crc32", "shard"
    )


#: Places of one shard that one task looks up together.
PORTION_BITS = 16


def _shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """``shard, n_tokens, before``: the ids of all shards before each, from the small columns alone."""
    sizes = spark.read.schema(SHARD_SCHEMA).parquet(path).select("shard", "n_tokens")
    return stored(add_starts(sizes, [], "shard", "n_tokens", "before", _MOST_SHARDS * 1024), "starts")


def _matrix(batch: pa.RecordBatch, at: int) -> WaveletMatrix:
    return WaveletMatrix(*[batch.column(name)[at].as_py() for name in ("n_tokens", "zeros", "planes", "ranks")])


def tokens_at(places: DataFrame, path: str, place: str = "place") -> DataFrame:
    """``place, token``: the ids at places of the whole sequence, read from stored shards.

    ``places`` has a column of places from 0, over all shards in order.  A place asked for
    twice comes once; null, negative places and those behind the end give no row, as do all
    places of an empty folder.  Places meet their shard by blocks of ids that it covers;
    each shard is asked in portions, so that no task holds more than 65,536 places.
    """
    spark = places.sparkSession
    block = SHARD_TOKENS
    starts = _shard_starts(spark, path).where("n_tokens > 0")
    covered = F.sequence(F.floor(F.col("before") / block), F.floor((F.col("before") + F.col("n_tokens") - 1) / block))
    blocks = starts.select("shard", "before", F.col("n_tokens").alias("length"), F.explode(covered).alias("block"))
    wanted = places.select(F.col(f"`{place}`").cast("long").alias("place")).where("place >= 0").distinct()
    met = wanted.withColumn("block", F.floor(F.col("place") / block)).join(blocks, "block")
    met = met.where("place >= before AND place < before + length").withColumn("inner", F.col("place") - F.col("before"))
    portions = met.groupBy("shard", "before", F.shiftright("inner", PORTION_BITS).alias("portion")).agg(
        F.collect_list("inner").alias("inner")
    )
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path).select("shard", "n_tokens", "zeros", "planes", "ranks")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                matrix, inner, before = _matrix(batch, at), batch.column("inner")[at].as_py(), batch.column("before")[at].as_py()
                columns = [[before + i for i in inner], [matrix.access(i) for i in inner]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["place", "token"])

    return portions.drop("portion").join(shards, "shard").mapInArrow(look, "place long, token long")


def count_tokens(spark: SparkSession, path: str, tokens: list[int], low: int = 0, high: int | None = None) -> DataFrame:
    """``token, n``: how often each of a few ids stands at the places from ``low`` to before ``high``.

    Every shard answers with two ranks per plane and id; nothing is decoded.  An id that
    does not occur has 0; without ``high`` all places from ``low`` on count.
    """
    asked = sorted(set(tokens))
    end = F.lit(high).cast("long") if high is not None else F.lit(None).cast("long")
    inside = _shard_starts(spark, path).select(
        "shard",
        F.greatest(F.lit(low) - F.col("before"), F.lit(0)).cast("long").alias("low"),
        F.least(F.coalesce(end - F.col("before"), F.col("n_tokens")), F.col("n_tokens")).alias("high"),
    )
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path).select("shard", "n_tokens", "zeros", "planes", "ranks")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                matrix, a, b = _matrix(batch, at), batch.column("low")[at].as_py(), batch.column("high")[at].as_py()
                found = [matrix.count(t, a, b) for t in asked]
                yield pa.RecordBatch.from_arrays([pa.array(asked, pa.int64()), pa.array(found, pa.int64())], ["token", "n"])

    met = inside.where("low < high").join(shards, "shard")
    counts = met.mapInArrow(tally, "token long, n long")
    every = spark.createDataFrame([(t, 0) for t in asked], "token long, n long")
    return counts.unionByName(every).groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(spark: SparkSession, path: str, token: int) -> DataFrame:
    """``place, doc_id, offset``: every place of an id, its document and the ids before it there.

    A shard without the id is left after one rank per plane; the others undo the planes
    for the places of this id only.  Documents of no ids are never met.
    """
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    names = ["place", "doc_id", "offset"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                inner = _matrix(batch, at).places(token)
                if not len(inner):
                    continue
                ends = np.cumsum(batch.column("doc_tokens")[at].as_py())
                doc = np.searchsorted(ends, inner, side="right")
                begins = np.concatenate([[0], ends])[doc]
                columns = [
                    pa.array(inner + batch.column("before")[at].as_py(), pa.int64()),
                    batch.column("doc_ids")[at].values.take(pa.array(doc, pa.int64())),
                    pa.array(inner - begins, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    kept = shards.join(_shard_starts(spark, path).select("shard", "before"), "shard")
    return kept.mapInArrow(find, "place long, doc_id long, offset long")
