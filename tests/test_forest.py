"""Forests from bootstrap sums: draws, cells against single rows, one tree against plain sums."""

import numpy as np
import pytest

from tablewright.operators import forest, modeling


def test_draws_are_poisson():
    found = np.bincount(forest.draws([1, 2, 3], 4, 400_000).astype(int), minlength=6) / 400_000
    wanted = np.exp(-1) / np.array([1, 1, 2, 6, 24, 120])
    assert np.abs(found[:6] - wanted).max() < 0.004
    assert np.array_equal(forest.draws([1], 2, 50), forest.draws([1], 2, 50))


@pytest.mark.parametrize("target", ["y", "c"])
def test_cells_and_single_rows_grow_the_same_trees(spark, monkeypatch, target):
    rng = np.random.default_rng(5)
    x, k = rng.integers(0, 6, 1200), rng.integers(0, 4, 1200)
    rows = [(float(a), "abcd"[b], float(a * 2 + b + e), "pqr"[(a + b) % 3]) for a, b, e in zip(x, k, rng.normal(0, 0.1, 1200))]
    df = spark.createDataFrame(rows, "x double, k string, y double, c string").select("x", "k", target).coalesce(2)
    grown = []
    for rows_a_cell in (1, 10**9):
        monkeypatch.setattr(forest, "ROWS_A_CELL", rows_a_cell)
        grown.append(modeling.fit(df, target, "Random Forest", rounds=6))
    one, other = (m.pipeline.stages[-1 if target == "y" else -2].forest for m in grown)
    assert (one.feature == other.feature).all() and (one.limit == other.limit).all()
    assert np.allclose(one.leaf, other.leaf) and len({t.tobytes() for t in one.leaf}) == 6
    scores = modeling.evaluate(grown[0], df)
    assert scores["r2" if target == "y" else "accuracy"] > 0.7


def test_few_cells_stand_for_many_rows():
    columns = forest.Columns([np.array([1.0])])
    codes = np.asfortranarray((np.arange(3200) % 2)[:, None].astype("uint8"))
    rows = forest.Cells(codes, np.arange(3200.0), seed=[7])
    cells = forest._condensed(columns, rows, 3, 0)
    assert len(cells.codes) == 2
    for tree in range(3):
        drawn = forest.draws([7], tree, 3200)
        assert cells.drawn[tree].tolist() == [drawn[::2].sum(), drawn[1::2].sum()]
        assert np.allclose(cells.summed[tree], [(drawn * rows.label)[::2].sum(), (drawn * rows.label)[1::2].sum()])
