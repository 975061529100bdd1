"""Boosted trees against a plain walk and a plain search of splits."""

import math

import numpy as np

from tessera.llm import quality_model as q


def walked(trees, row):
    total = trees.bias
    for feature, threshold, value in zip(trees.feature, trees.threshold, trees.value, strict=True):
        at = 0
        while at < len(feature):
            at = 2 * at + 1 + int(row[feature[at]] > threshold[at])
        total += value[at - len(feature)]
    return 1 / (1 + math.exp(-total))


def split(x, g, h):
    """The best (gain, feature, threshold) of rows, by trying every edge of the whole table's bins."""
    best = (0.0, 0, math.inf)
    for k in range(x.shape[1]):
        for edge in EDGES[k]:
            left = x[:, k] <= edge
            if min(left.sum(), (~left).sum()) < q.LEAST:
                continue
            gain = g[left].sum() ** 2 / (h[left].sum() + q.RIDGE) + g[~left].sum() ** 2 / (h[~left].sum() + q.RIDGE) - g.sum() ** 2 / (h.sum() + q.RIDGE)
            if gain > best[0] + 1e-9:
                best = (gain, k, edge)
    return best


EDGES = []


def test_splits_and_scores():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 4)).round(1)
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] * x[:, 1] > 0.2)).astype(float)
    trees = q.grow(x, y, trees=6, depth=3)
    EDGES[:] = [np.unique(np.quantile(c, np.linspace(0, 1, q.BINS + 1)[1:-1])) for c in x.T]
    margin = np.full(len(y), trees.bias)
    for nth in range(6):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        rows = {0: np.arange(len(y))}
        for node in range(7):
            own = rows[node]
            gain, k, edge = split(x[own], g[own], h[own]) if len(own) else (0.0, 0, math.inf)
            assert (trees.feature[nth, node], trees.threshold[nth, node]) == ((k, edge) if gain > 0 else (0, math.inf))
            right = x[own, k] > edge
            rows[2 * node + 1], rows[2 * node + 2] = own[~right], own[right]
        for leaf in range(8):
            own = rows[7 + leaf]
            value = -q.RATE * g[own].sum() / (h[own].sum() + q.RIDGE)
            assert math.isclose(trees.value[nth, leaf], value, abs_tol=1e-9)
            margin[own] += value
    got = trees.score(np.concatenate([x, np.array([[np.nan, 0, 1, 2], [9, 9, 9, 9], [-9, -9, -9, -9]])]))
    assert np.allclose(got[:600], [walked(trees, r) for r in x], atol=1e-12)
    assert math.isclose(got[601], walked(trees, [9] * 4)) and math.isclose(got[602], walked(trees, [-9] * 4))
    assert ((got[:600] >= 0.5) == (y == 1)).mean() > 0.85
