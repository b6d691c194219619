"""Threshold walk and rounds of centroids against plain distances."""

import hashlib
import math

import __spark_entry__ as entry
import numpy as np
from tablewright.llm import centroids
from tests.conftest import SF
from tests.oracle import difference, duck


def plain(ids, rows, clusters=40, dimensions=64, rounds=5, salt="2:"):
    """Rows of the result by plain loops over exact integers."""
    kept = [
        (i, [math.floor(256 * float(x)) for x in row])
        for i, row in zip(ids, rows)
        if row is not None and len(row) == dimensions and all(x is not None and math.isfinite(x) for x in row)
    ]
    key = lambda r: (hashlib.sha256(f"{salt}{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centres = [list(p) for _, p in sorted(kept, key=key)[:clusters]]

    def nearest(p):
        return min((sum((a - b) ** 2 for a, b in zip(p, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        found = [nearest(p)[1] for _, p in kept]
        for n in set(found):
            mine = [p for (_, p), f in zip(kept, found) if f == n]
            centres[n] = [sum(x) // len(mine) for x in zip(*mine)]
    result, inertia = [], {}
    for i, p in kept:
        d, n = nearest(p)
        inertia[n] = inertia.get(n, 0) + d
        result.append((i, n, d))
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), digest[n]) for i, n, d in result), key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_given_vectors_against_sql(spark):
    query, sql = entry.queries()["op13_centroids"], entry.oracle_sql()["op13_centroids"]
    assert difference(query(spark, SF), duck(SF), sql) is None


def test_walk_finds_the_nearest_and_skips_distances():
    rng = np.random.default_rng(1)
    for spread, n in ((1, 40), (60, 200)):
        means = rng.integers(-900, 900, (12, 5))
        points = rng.integers(-spread, spread + 1, (n * 12, 5)) + np.repeat(means, n, axis=0)
        centres = np.vstack([means, means[3], rng.integers(-900, 900, (20, 5))])  # one stands twice
        number, distance, computed = centroids.Lists(centres).nearest(points)
        exact = ((points[:, None] - centres[None]) ** 2).sum(axis=2)
        assert (number == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
        assert computed < 0.5 * exact.size
        wide = centroids.Lists(centres.astype(object)).nearest(points[::17].astype(object))
        assert (wide[0].astype(int) == number[::17]).all() and (wide[1].astype(int) == distance[::17]).all()


def test_ties_need_a_strictly_larger_sum():
    centres = np.array([[4, 0], [-4, 0], [0, 4], [0, -4]])
    number, distance, _ = centroids.Lists(centres).nearest(np.array([[0, 0], [1, 1], [0, 2]]))
    assert number.tolist() == [0, 0, 2] and distance.tolist() == [16, 10, 4]


def test_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [[float(np.float32(x)) for x in rng.normal(size=4)] for _ in range(60)]
    rows += [rows[0]] * 40 + [[1.0, 2.0], None, [], [1.0, None, 2.0, 3.0], [float("nan")] * 4, [float("inf"), 0.0, 0.0, 0.0]]
    rows += [[2.0e6, -3.0e6, 1.0, 0.0], [-0.001953125, 0.001953125, 0.0, -0.0]]
    ids = [*range(58), None, 3, *range(60, len(rows))]
    schema = "vec_id long, embedding array<float>, cluster int, distance string, point int"
    df = spark.createDataFrame([(i, r, 1, "x", 2) for i, r in zip(ids, rows)], schema).repartition(5)
    result = centroids.cluster(df, clusters=7, dimensions=4, rounds=3)
    assert found(result) == plain(ids, rows, 7, 4, 3)


def test_fewer_vectors_than_clusters_and_none(spark):
    rows = [[1.0, 2.0], [3.0, 4.0], [1.0, 2.0]]
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    assert found(centroids.cluster(df, clusters=5, dimensions=2)) == plain(range(3), rows, 5, 2)
    empty = centroids.cluster(df.where("vec_id < 0"), clusters=5, dimensions=2)
    assert empty.collect() == [] and empty.columns == centroids.cluster(df, clusters=5, dimensions=2).columns
