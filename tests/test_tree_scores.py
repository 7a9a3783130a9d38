"""Scores of trees against a walk of each row, with missing numbers, a single leaf and no rows."""

import numpy as np
import pytest

from pitchflow.operators import forest

KINDS = {"feature": int, "threshold": float, "below": int, "above": int, "value": float}


def walked(tree, row):
    at = 0
    while tree["feature"][at] >= 0:
        at = tree["below" if row[tree["feature"][at]] <= tree["threshold"][at] else "above"][at]
    return tree["value"][at]


def test_every_row_comes_to_its_leaf():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 5))
    trees = [forest._flat(forest.grow_isolation(x[rng.choice(500, n)], 8, rng)) for n in (1, 2, 40, 256)]
    trees.append(forest.grow_tree(x.astype(np.float32), (x[:, 0] > x[:, 1]).astype(int), np.ones(500), rng, 6))
    x[::7, 2] = np.nan
    for t in trees:
        tree = {k: np.array(t[k], kind) for k, kind in KINDS.items()}
        for some in (x, x[:1], x[:0], np.asfortranarray(x), x.astype(np.float32)):
            assert forest.tree_scores(tree, some).tolist() == [walked(tree, r) for r in some]


@pytest.mark.parametrize("parts", [1, 7])
def test_trees_of_a_large_table_are_grown_from_all_its_rows(spark, monkeypatch, parts):
    """Beyond POOL rows trees are those that grow_tree() finds from the bootstrap samples of the whole table.

    Leaves have 20 rows or more, so that no two splits are equally good but for the last bit.
    """

    class InOrder:  # all features at every node, in order
        def permutation(self, n):
            return np.arange(n)

    monkeypatch.setattr(forest.np, "sqrt", lambda n: n)
    rng = np.random.default_rng(3)
    data = [(i, "abc"[rng.integers(3)] if i % 11 else None, float(np.round(rng.normal(), 2)), float(rng.integers(8)), i % 3) for i in range(2000)]
    data = [(*r, int((r[2] > 0.3 or r[1] == "b") ^ (rng.random() < 0.1))) for r in data]
    rows = spark.createDataFrame(data, "id bigint, kind string, x double, z double, fold int, label int").repartition(parts)
    encoding = forest.Encoding.of(rows, ("kind",), ("x", "z"))
    pool = forest.Pool(rows, encoding, ("id",), "label", "fold")
    monkeypatch.setattr(forest, "POOL", 60)
    monkeypatch.setattr(forest, "CELLS", 300)
    got = forest.collected(forest.fit_forests(rows, encoding, ("id",), [0, 2], trees=2, depth=5, min_split=60, min_leaf=20))
    assert {m: len(t) for m, t in got.items()} == {0: 2, 2: 2}
    for number, (model, tree) in enumerate((m, t) for m in (0, 2) for t in got[m]):
        counts = forest.poisson_counts(pool.h, number) * (pool.fold != model)
        used = np.flatnonzero(counts)
        want = forest.grow_tree(pool.x[used], pool.y[used], forest.balanced_weights(counts[used], pool.y[used]), InOrder(), 5, 60, 20)
        want = {k: np.array(v) for k, v in want.items()}
        assert len(want["value"]) == len(tree["value"]) > 10
        assert np.allclose(forest.tree_scores(tree, pool.x), forest.tree_scores(want, pool.x))
    monkeypatch.setattr(forest, "BINS", 20)  # the places of x are ranges of as many rows each
    codes = forest._Codes(rows, encoding)
    inside = [sum(a <= np.float32(r[2]) <= b for r in data) for a, b in zip(codes.lo[0], codes.hi[0], strict=True)]
    assert len(inside) <= 20 and sum(inside) == 2000 and max(inside) <= 150 and len(codes.lo[1]) == 8
