"""Bagged decision trees on few numeric features, trained on a bounded sample."""

from __future__ import annotations

import numpy as np


class Tree:
    """A binary classification tree: splits by the greatest fall of the Gini index over quantile cuts, each split over
    some features drawn anew."""

    def __init__(self, depth: int, least: int, tried: int, rng: np.random.Generator):
        self.depth, self.least, self.tried, self.rng = depth, least, tried, rng
        self.nodes: list[tuple] = []  # (feature, cut, left, right) or (value,)

    def fit(self, x: np.ndarray, y: np.ndarray, cuts: list[np.ndarray]) -> "Tree":
        self._grow(x, y, cuts, self.depth)
        return self

    def _grow(self, x, y, cuts, depth) -> int:
        at = len(self.nodes)
        self.nodes.append((float(y.mean()),))
        if depth == 0 or len(y) < 2 * self.least or y.min() == y.max():
            return at
        best, n, total = (0.0, -1, 0.0), len(y), y.sum()
        base = total * (n - total) / n
        for f in np.sort(self.rng.permutation(len(cuts))[: self.tried]):
            c = cuts[f]
            if not len(c):
                continue
            place = np.searchsorted(c, x[:, f], side="left")  # x <= c[k] goes left for k >= place
            count = np.cumsum(np.bincount(place, minlength=len(c) + 1))[:-1]
            ones = np.cumsum(np.bincount(place, weights=y, minlength=len(c) + 1))[:-1]
            fits = (count >= self.least) & (n - count >= self.least)
            if not fits.any():
                continue
            k, s = count[fits], ones[fits]
            gain = base - s * (k - s) / k - (total - s) * (n - k - total + s) / (n - k)
            j = int(np.argmax(gain))
            if gain[j] > best[0] + 1e-12:
                best = (float(gain[j]), f, float(c[fits][j]))
        if best[1] < 0:
            return at
        left = x[:, best[1]] <= best[2]
        a = self._grow(x[left], y[left], cuts, depth - 1)
        b = self._grow(x[~left], y[~left], cuts, depth - 1)
        self.nodes[at] = (best[1], best[2], a, b)
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        todo = [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            node = self.nodes[at]
            if len(node) == 1:
                out[rows] = node[0]
            elif len(rows):
                left = x[rows, node[0]] <= node[1]
                todo += [(node[2], rows[left]), (node[3], rows[~left])]
        return out


class Bag:
    """Trees on bootstrap samples with as many rows of each label; the prediction is their mean. Rows of the rarer label
    are drawn more than once, so a rare kind of page is not outvoted."""

    def __init__(self, trees: int = 61, depth: int = 10, least: int = 3, tried: int = 4, seed: int = 0):
        self.size, self.depth, self.least, self.tried, self.seed = trees, depth, least, tried, seed
        self.trees: list[Tree] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Bag":
        """y holds both labels, 0 and 1."""
        rng = np.random.default_rng(self.seed)
        labels = [np.flatnonzero(y == v) for v in (0, 1)]
        cuts = []
        for f in range(x.shape[1]):
            q = np.unique(np.concatenate([np.quantile(x[rows, f], np.linspace(0, 1, 129)) for rows in labels]))
            cuts.append((q[1:] + q[:-1]) / 2)
        for _ in range(self.size):
            rows = np.concatenate([rng.choice(rows, max(1, len(y) // 2)) for rows in labels])
            self.trees.append(Tree(self.depth, self.least, self.tried, rng).fit(x[rows], y[rows], cuts))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.mean([t.predict(x) for t in self.trees], axis=0) if len(x) else np.zeros(0)
