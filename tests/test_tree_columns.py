"""Flags that share a column of codes, and rows that are scored once."""

import numpy as np

from tablewright.operators import boosting
from tablewright.operators.treebins import Columns

LIMITS = [np.array([2.0, 4.0]), *[np.array([0.5])] * 5]


def some_rows():
    rng = np.random.default_rng(3)
    flags = np.eye(6)[rng.integers(0, 6, 400)][:, :5]
    return np.column_stack([rng.uniform(0, 6, 400), flags])


def test_flags_of_one_column_are_one_code():
    values = some_rows()
    plain, shared = Columns(LIMITS), Columns(LIMITS, (5,))
    codes = shared.encode(values)
    assert codes.shape == (400, 2) and codes.dtype == "uint8"
    node = np.random.default_rng(4).integers(0, 3, 400)
    weight = np.arange(400.0)
    wanted = plain.add_up(plain.encode(values), node, 3, [weight])
    assert np.array_equal(shared.by_feature(shared.add_up(codes, node, 3, [weight])), wanted)
    feature, limit = np.array([3, 0, -1]), np.array([0, 1, 0])
    assert np.array_equal(shared.walk(codes, feature, limit, 2), plain.walk(plain.encode(values), feature, limit, 2))


def test_rows_with_equal_codes_go_down_the_trees_once(monkeypatch):
    values = some_rows()
    forest = boosting.Forest.empty("regression", np.zeros(1), LIMITS, 1, (5,))
    forest.add_round()
    forest.feature[0, 0], forest.leaf[0, 0] = 0, [1.0, 2.0]
    walked, plain = [], boosting.Forest.raise_margins
    monkeypatch.setattr(boosting.Forest, "raise_margins", lambda self, codes, m: walked.append(len(codes)) or plain(self, codes, m))
    assert np.array_equal(forest.predict(values), np.where(values[:, 0] >= 2, 2.0, 1.0))
    assert walked[0] <= 18
    assert boosting.Forest.from_json(forest.to_json()).groups == (5,)
