"""Small decision-tree ensembles in numpy, for a few thousand labelled rows: a random forest and gradient boosting.

Trees are grown depth first over at most 32 quantile cuts a feature, and kept as flat arrays for vectorised scoring.
"""

from __future__ import annotations

import numpy as np


class Tree:
    """feature[i] < 0: a leaf with value[i]; else rows with x[feature] <= cut go to left, others to right."""

    def __init__(self, x: np.ndarray, target: np.ndarray, weight: np.ndarray, depth: int, least: int, some: int, rng: np.random.Generator) -> None:
        self.feature, self.cut, self.left, self.right, self.value = [], [], [], [], []
        self.cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 34)[1:-1])) for f in range(x.shape[1])]
        self.grow(x, target, weight, depth, least, some, rng)
        self.feature, self.left, self.right = (np.array(v, np.int64) for v in (self.feature, self.left, self.right))
        self.cut, self.value = np.array(self.cut), np.array(self.value)

    def grow(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, depth: int, least: int, some: int, rng: np.random.Generator) -> int:
        me = len(self.feature)
        for v, start in ((self.feature, -1), (self.cut, 0.0), (self.left, 0), (self.right, 0)):
            v.append(start)
        self.value.append(float(y.sum() / max(w.sum(), 1e-12)))
        best = (1e-9, -1, 0.0)
        if depth and len(y) >= 2 * least:
            whole = y.sum() ** 2 / w.sum()
            for f in np.sort(rng.choice(x.shape[1], min(some, x.shape[1]), replace=False)):
                side = x[:, f][:, None] <= self.cuts[f][None, :]
                n, sy, sw = side.sum(0), y @ side, w @ side
                ok = (n >= least) & (len(y) - n >= least)
                if ok.any():
                    gain = np.where(ok, sy**2 / np.maximum(sw, 1e-12) + (y.sum() - sy) ** 2 / np.maximum(w.sum() - sw, 1e-12) - whole, -1)
                    if gain.max() > best[0]:
                        best = (gain.max(), int(f), float(self.cuts[f][gain.argmax()]))
        if best[1] >= 0:
            self.feature[me], self.cut[me] = best[1], best[2]
            side = x[:, best[1]] <= best[2]
            self.left[me] = self.grow(x[side], y[side], w[side], depth - 1, least, some, rng)
            self.right[me] = self.grow(x[~side], y[~side], w[~side], depth - 1, least, some, rng)
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while (inner := self.feature[at] >= 0).any():
            rows = np.flatnonzero(inner)
            node = at[rows]
            go = x[rows, self.feature[node]] <= self.cut[node]
            at[rows] = np.where(go, self.left[node], self.right[node])
        return self.value[at]


class Forest:
    """Random forest for labels 0 and 1: bootstrap rows, a random part of the features at each split."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 8, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        some = max(1, round(x.shape[1] ** 0.5) + 1)
        self.trees = []
        for _ in range(trees):
            rows = rng.integers(0, len(x), len(x))
            self.trees.append(Tree(x[rows], y[rows].astype(float), np.ones(len(rows)), depth, 2, some, rng))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.mean([t.predict(x) for t in self.trees], 0) if len(x) else np.empty(0)


class Boosted:
    """Gradient-boosted trees for labels 0 and 1: logistic loss, Newton steps at the leaves."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        share = min(max(float(np.mean(y)), 1e-3), 1 - 1e-3)
        self.rate, self.start, self.trees = rate, float(np.log(share / (1 - share))), []
        margin = np.full(len(x), self.start)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            tree = Tree(x, y - p, p * (1 - p) + 1e-6, depth, 5, x.shape[1], rng)
            self.trees.append(tree)
            margin += rate * tree.predict(x)

    def predict(self, x: np.ndarray) -> np.ndarray:
        margin = self.start + self.rate * sum(t.predict(x) for t in self.trees) if len(x) else np.empty(0)
        return 1 / (1 + np.exp(-margin))
