"""Nearest neighbours: recall and exact scores against brute force."""

import numpy as np

import __spark_entry__ as entry
from pyspark.sql import functions as F
from tablewright.llm import ann
from tests.conftest import SF

def every():
    return F.col("vec_id") % 50 == 0


def brute_force(ids, rows, k=5):
    """The nearest ids and scores of every fiftieth row."""
    unit = rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    result = {}
    for i in np.flatnonzero(ids % 50 == 0):
        score = unit @ unit[i]
        order = [j for j in np.lexsort((ids, -np.round(score, 13))) if ids[j] != ids[i]][:k]
        result[int(ids[i])] = [(int(ids[j]), float(score[j])) for j in order]
    return result


def recall(found, ids, rows):
    want, got = brute_force(ids, rows), {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(want)
    place = {int(v): i for i, v in enumerate(ids)}
    for query, near in got.items():
        assert len(near) == len(want[query])
        for vec_id, score in near:
            a, b = rows[place[query]], rows[place[vec_id]]
            assert abs(score - (a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum())) < 1e-12
        assert [(-s, v) for v, s in near] == sorted((-s, v) for v, s in near)
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in near}) for q, near in want.items())
    return hits / sum(map(len, want.values()))


def test_given_vectors(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    found = entry.queries()["op10_nearest"](spark, SF).collect()
    assert recall(found, table["vec_id"].to_numpy(), np.stack(table["embedding"]).astype(np.float64)) >= 0.9


def test_recall_over_several_parts_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROWS_PER_PART", 100)
    monkeypatch.setattr(ann, "SAMPLE_ROWS", 1500)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 150)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    rows = centres[rng.integers(0, 12, 3000)] + 0.3 * rng.normal(size=(3000, 16))
    rows[rng.choice(3000, 1000, replace=False)] = rows[7]  # one vector fills a third
    ids = rng.permutation(3000)
    router, parts, probes = ann.fit(rows[:1500] / np.linalg.norm(rows[:1500], axis=1, keepdims=True), 3000)
    assert parts == 16 and 1 <= probes < 16
    df = spark.createDataFrame([(int(i), r.tolist()) for i, r in zip(ids, rows)], "vec_id long, embedding array<double>")
    assert recall(ann.nearest(df, every()).collect(), ids, rows) >= 0.9


def test_parts_are_balanced():
    rng = np.random.default_rng(4)
    unit = rng.normal(size=(1000, 8))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    graph = ann.neighbour_graph(unit, 10)
    part = ann.balanced_parts(unit, graph, 8)
    assert np.bincount(part, minlength=8).max() <= 138
    random_part = rng.permutation(np.arange(1000) % 8)
    assert (part[graph] == part[:, None]).mean() > 2 * (random_part[graph] == random_part[:, None]).mean()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]),
        (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0]), (None, [1.0, 1.0]), (50, [1.0, 0.0]),
        (100, [-1e300, 1e300]), (150, None), (10, [1e-300, 1e-300]),
    ]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, rank int, part int")
    found = ann.nearest(df, every()).collect()
    near = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        near.setdefault(r["query_id"], []).append((r["vec_id"], round(r["score"], 9)))
    h = round(0.5**0.5, 9)
    assert near == {
        0: [(1, 1.0), (2, 1.0), (50, 1.0), (10, h), (3, 0.0)],
        50: [(0, 1.0), (1, 1.0), (2, 1.0), (10, h), (3, 0.0)],
        100: [(3, h), (10, 0.0), (0, -h), (1, -h), (2, -h)],
    }
    assert ann.nearest(df.limit(0), every()).count() == 0
    assert ann.nearest(df.where("vec_id = 4"), every()).columns == ["query_id", "rank", "vec_id", "score"]


def test_recall_outside_the_sample():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(300, 64))
    unit = centres[rng.integers(0, 300, 30000)] + rng.normal(size=(30000, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    router, parts, probes = ann.fit(unit[:6000], len(unit))
    assert parts == 64 and probes < 64
    asked = unit[6000:7500]
    near = asked @ unit.T
    near[np.arange(len(asked)), np.arange(6000, 7500)] = -1
    best = np.argpartition(-near, 4, axis=1)[:, :5]
    place = np.argsort(np.argsort(-router.scores(asked), axis=1), axis=1)
    home = np.argmax(router.scores(unit), axis=1)
    assert (place[np.arange(len(asked))[:, None], home[best]] < probes).mean() >= 0.95
