"""Centroid clustering of vectors, each assigned by the threshold algorithm.

For every dimension the centroids stand in a list sorted by their component.  From a
vector's own value each list is walked outward, nearest component first, all lists in
step.  A centroid met for the first time gets its exact distance.  The squared gaps to
the fronts of all lists add up to the least distance that a centroid not met yet can
have: once that sum is strictly above the best exact distance, the walk ends.  It has to
be strictly above, since a centroid at the same distance wins if its number is smaller.

All sums are sums of integers, so results do not depend on how rows are dealt to tasks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import stored

#: Vectors walked together; bounds a task's memory to some tens of MB.
BATCH_ROWS = 1024
#: Up to this size of a component, squared distances over 512 dimensions fit into 64 bits.
SAFE_COMPONENT = 1 << 26
SCALE = 256


class Lists:
    """Sorted lists of centroids, one per dimension."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = centroids
        self.numbers = np.argsort(centroids, axis=0, kind="stable").T.copy()
        self.values = np.sort(centroids, axis=0).T.copy()

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of the nearest centroid, and how many distances were computed.

        ``rows`` and the centroids hold integers: 64-bit ones where no sum can leave them,
        Python's own otherwise.
        """
        k, n = len(self.centroids), len(rows)
        walked = np.arange(rows.shape[1])
        high = np.empty(rows.shape, np.int64)
        for d in walked:
            high[:, d] = np.searchsorted(self.values[d], rows[:, d])
        low = high - 1
        known = np.zeros((n, k), bool)
        distance = np.zeros((n, k), rows.dtype)
        cluster, best = np.zeros(n, np.int64), np.zeros(n, rows.dtype)
        active, computed = np.arange(n), 0
        for step in range(k):
            mine = rows[active]
            below = mine - self.values[walked, np.maximum(low, 0)]
            above = self.values[walked, np.minimum(high, k - 1)] - mine
            down = (high == k) | ((low >= 0) & (below <= above))
            front = np.where(down, below, above)
            met = self.numbers[walked, np.where(down, low, high)]
            low, high = low - down, high + ~down
            fresh = np.zeros((len(active), k), bool)
            fresh[np.arange(len(active))[:, None], met] = True
            at, number = np.nonzero(fresh & ~known[active])
            gaps = mine[at] - self.centroids[number]
            distance[active[at], number] = (gaps * gaps).sum(axis=1)
            known[active[at], number] = True
            computed += len(at)
            if rows.dtype == object:
                cluster[active] = [min(np.flatnonzero(known[i]), key=lambda c, i=i: (distance[i, c], c)) for i in active]
            else:
                unknown = np.iinfo(np.int64).max
                cluster[active] = np.where(known[active], distance[active], unknown).argmin(axis=1)
            best[active] = distance[active, cluster[active]]
            going = (front * front).sum(axis=1) <= best[active]
            if step == k - 1 or not going.any():
                break
            active, low, high = active[going], low[going], high[going]
        return cluster, best, computed


def floor_of(x: float) -> int:
    """floor(256 * x), also where the product leaves the range of a double."""
    return math.floor(x * SCALE) if abs(x) < 2.0**1000 else int(x) * SCALE


def as_integers(rows: np.ndarray) -> np.ndarray:
    """The rows as 64-bit integers, or as Python's integers where distances could leave 64 bits."""
    small = len(rows) == 0 or float(np.abs(rows).max()) * SCALE < SAFE_COMPONENT and rows.shape[1] <= 512
    if small:
        return np.floor(rows * SCALE).astype(np.int64)
    return np.array([[floor_of(x) for x in row] for row in rows.tolist()], dtype=object)


def vectors_of(batch: pa.RecordBatch, column: str, dimensions: int) -> np.ndarray:
    values = batch.column(column).flatten().to_numpy(zero_copy_only=False)
    return values.reshape(-1, dimensions)


def start_key(number: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(salt), F.coalesce(number.cast("string"), F.lit(""))), 256)


def usable(vector: Column, dimensions: int) -> Column:
    """Whether a vector has that many components, none null or non-finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return F.coalesce((F.size(vector) == dimensions) & finite, F.lit(False))


def _matcher(centroids: list[list[int]], column: str, dimensions: int):
    """Centroids, and the walk over one batch of rows."""
    of_int = np.array(centroids, dtype=object)
    small = all(abs(x) <= SAFE_COMPONENT for c in centroids for x in c)
    narrow = Lists(of_int.astype(np.int64)) if small else None

    def match(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = as_integers(vectors_of(batch, column, dimensions))
        if narrow is not None and rows.dtype != object:
            return rows, *narrow.nearest(rows)[:2]
        rows = rows.astype(object)
        return rows, *Lists(of_int).nearest(rows)[:2]

    return match


def cluster_sums(rows: DataFrame, centroids: list[list[int]], dimensions: int) -> dict[int, tuple[int, list[int]]]:
    """Per cluster that has vectors: their number and the exact sum of each component.

    Every task sends one row per cluster, and so does every merge of them; what reaches
    the driver is one row per centroid.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = _matcher(centroids, "point", dimensions)
        counts: dict[int, int] = {}
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for low in range(0, len(batch), BATCH_ROWS):
                points, cluster, _ = match(batch.slice(low, BATCH_ROWS))
                for c in np.unique(cluster).tolist():
                    mine = points[cluster == c]
                    counts[c] = counts.get(c, 0) + len(mine)
                    sums[c] = sums.get(c, 0) + mine.sum(axis=0).astype(object)
        numbers = sorted(counts)
        decimals = [[str(x) for x in sums[c]] for c in numbers]
        yield pa.RecordBatch.from_pydict(
            {
                "cluster": pa.array(numbers, pa.int32()),
                "n": pa.array([counts[c] for c in numbers], pa.int64()),
                "sums": pa.array(decimals, pa.list_(pa.string())),
            }
        )

    parts = rows.select("point").mapInArrow(partial, "cluster int, n long, sums array<string>")
    total = [F.sum(F.col("sums")[d].cast("decimal(38,0)")).alias(f"s{d}") for d in range(dimensions)]
    merged = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *total).collect()
    return {r["cluster"]: (r["n"], [int(r[f"s{d}"]) for d in range(dimensions)]) for r in merged}


def cluster(
    df: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    clusters: int = 40,
    dimensions: int = 64,
    rounds: int = 5,
    salt: str = "2:",
) -> DataFrame:
    """One row per usable vector with its cluster, after ``rounds`` of moving the centroids.

    Columns: the key, ``cluster``, ``distance`` (squared, in units of 1/256 a component),
    ``cluster_inertia`` and ``inertia`` (distances summed over the cluster and over all),
    and ``centroid_sha256``, the digest of the final centroid's components joined by commas.

    A component x counts as floor(256 * x).  The vectors with the ``clusters`` smallest
    digests of salt and key are the first centroids, ties by their components; a null key
    has the digest of the salt alone.  A round assigns all vectors and moves each centroid
    that has any to floor(sum / count) of each component; others stay.

    Null vectors and those of another length or with null or non-finite components are left
    out.  Repeated rows each count and come back each.  With fewer vectors than clusters
    every vector starts one; an empty table gives no rows.  Other columns of ``df`` are not
    read, whatever their names.  Distances that 64 bits cannot hold raise an error.

    The table is read once; each round is one scan of the usable vectors written from it,
    and sends one row per centroid and task.
    """
    spark = df.sparkSession
    named = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").alias("vector"))
    doubles = F.col("vector").cast("array<double>").alias("point")
    rows = stored(named.where(usable(F.col("vector"), dimensions)).select("key", doubles), "points")
    first = rows.orderBy(start_key(F.col("key"), salt), "point").limit(clusters).select("point").collect()
    schema = f"`{key}` {dict(df.dtypes)[key]}, cluster int, distance long"
    if not first:
        empty = spark.createDataFrame([], schema)
        return empty.select("*", *[F.lit(0).cast("long").alias(c) for c in ("cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    centroids = [[floor_of(x) for x in r["point"]] for r in first]
    for _ in range(rounds):
        for number, (n, sums) in cluster_sums(rows, centroids, dimensions).items():
            centroids[number] = [s // n for s in sums]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = _matcher(centroids, "point", dimensions)
        for batch in batches:
            for low in range(0, len(batch), BATCH_ROWS):
                part = batch.slice(low, BATCH_ROWS)
                _, number, distance = match(part)
                columns = [part.column("key"), pa.array(number.astype(np.int32)), pa.array(distance.tolist(), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [key, "cluster", "distance"])

    assigned = stored(rows.mapInArrow(assign, schema), "assigned")
    found = assigned.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()
    total = sum(r["inertia"] for r in found)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    final = spark.createDataFrame(
        [(r["cluster"], r["inertia"], total, digests[r["cluster"]]) for r in found],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return assigned.join(F.broadcast(final), "cluster").select(
        key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
