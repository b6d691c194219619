"""Bounded-space online packing of documents into token sequences of one length.

Each partition keeps a fixed number of open windows.  Whole windows of a long
document are sequences of their own; what is left of it goes into the open window
that it fills best.  When none has room and all are open, the fullest is emitted
as it is.  Windows still open at the end of the partitions are merged at last, the
longest pieces first.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from zlib import crc32

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import stored
from tablewright.llm.tokens import encode_documents

OPEN_WINDOWS = 128
#: So many partitions merge their open windows in one task.
MERGED_PARTITIONS = 64
_ROWS = 20_000

PIECE_COLUMNS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Windows:
    """Open windows of ``size`` tokens, at most ``most`` of them, and the pieces in each."""

    def __init__(self, size: int, most: int | None, first_id: int) -> None:
        self.size, self.most, self.next_id = size, most, first_id
        self.room: list[tuple[int, int]] = []  # (room left, sequence), smallest room first
        self.held: dict[int, list[tuple]] = {}
        self.done: list[tuple] = []  # pieces of closed windows

    def place(self, *piece: int) -> None:
        """Best fit for a piece ``(row, start, length, ...)``; else a new window for the fullest."""
        length = piece[2]
        at = bisect_left(self.room, (length, -1))
        if at < len(self.room):
            room, sequence = self.room.pop(at)
        else:
            if self.most is not None and len(self.room) >= self.most:
                self.done += self.held.pop(self.room.pop(0)[1])
            room, sequence = self.size, self.next_id
            self.held[sequence] = []
            self.next_id += 1
        self.held[sequence].append((*piece, sequence, self.size - room))
        if room > length:
            insort(self.room, (room - length, sequence))
        else:
            self.done += self.held.pop(sequence)

    def close(self) -> list[tuple]:
        """The pieces of all windows that are still open."""
        rest = [piece for pieces in self.held.values() for piece in pieces]
        self.held, self.room = {}, []
        return rest


def pack(docs: DataFrame, key: str, text: str, tokenizer: str, end_id: int, size: int = 2048) -> DataFrame:
    """One row per piece: ``key, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Every id of every document, the end id included, lies in exactly one piece; pieces
    of a sequence follow each other from offset 0.  A document of at most ``size`` ids is
    never cut.  A null text has the end id alone; equal rows are packed each by itself;
    other columns are ignored; an empty table gives no pieces.  The last windows of a
    partition, at most 128, go on to the merge; they hold less than one row in a
    thousand of a partition of usual size.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        windows, keys = Windows(size, OPEN_WINDOWS, part << 32), None
        for batch in batches:
            # A piece of an open window may outlive its batch, so it takes its key along.
            keys = batch.column("key").to_pylist()
            for row, ids in encode_documents(tokenizer, end_id, batch.column("text")):
                for start in range(0, len(ids), size):
                    piece = ids[start : start + size]
                    windows.place(keys[row], start, len(piece), crc32(piece), len(ids))
                if len(windows.done) >= _ROWS:
                    yield batch_of(windows.done, batch.column("key").type, part, False)
                    windows.done = []
            kept, windows.done = windows.done, []
            yield batch_of(kept, batch.column("key").type, part, False)
        if keys is not None:
            yield batch_of(windows.close(), batch.column("key").type, part, True)

    placed = stored(rows.mapInArrow(place, f"key {kind}, {PIECE_COLUMNS}, part long, open boolean"), "pieces")
    closed = placed.where(~F.col("open")).select(_NAMES)
    group = F.floor(F.col("part") / MERGED_PARTITIONS)

    def merge(group: tuple, table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values(["length", "sequence_id", "offset"], ascending=[False, True, True])
        windows = Windows(size, None, (group[0] * MERGED_PARTITIONS << 32) + (1 << 31))
        for place, (start, length) in enumerate(zip(table["start"].tolist(), table["length"].tolist())):
            windows.place(place, start, length)
        found = sorted(windows.done + windows.close())
        return table.assign(sequence_id=[f[3] for f in found], offset=[f[4] for f in found])[_NAMES]

    merged = placed.where("open").groupBy(group.alias("group")).applyInPandas(merge, f"key {kind}, {PIECE_COLUMNS}")
    return closed.unionByName(merged).withColumnRenamed("key", key)


def batch_of(pieces: list[tuple], key_type: pa.DataType, part: int, is_open: bool) -> pa.RecordBatch:
    columns = list(zip(*pieces)) if pieces else [()] * len(_NAMES)
    arrays = [pa.array(columns[0], key_type), *[pa.array(c, pa.int64()) for c in columns[1:]]]
    arrays += [pa.array([part] * len(pieces), pa.int64()), pa.array([is_open] * len(pieces), pa.bool_())]
    return pa.RecordBatch.from_arrays(arrays, [*_NAMES, "part", "open"])


_NAMES = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
