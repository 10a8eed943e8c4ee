"""Binned decision trees in numpy, shared by the models that are trained here."""

from __future__ import annotations

import numpy as np


class Bins:
    """At most 32 bins of each feature, cut at quantiles of the training rows."""

    def __init__(self, rows: np.ndarray, most: int = 32):
        self.cuts = [np.unique(np.quantile(column, np.linspace(0, 1, most + 1)[1:-1])) for column in rows.T]

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        out = np.empty(rows.shape, np.uint8)
        for k, cuts in enumerate(self.cuts):
            out[:, k] = np.searchsorted(cuts, rows[:, k], "left")
        return out


class Tree:
    """Nodes as arrays; a row goes left where its bin is at most the threshold."""

    def __init__(self):
        self.feature, self.threshold, self.left, self.right, self.value = [], [], [], [], []

    def add(self, value: float) -> int:
        for array, x in zip((self.feature, self.threshold, self.left, self.right, self.value), (-1, 0, 0, 0, value), strict=True):
            array.append(x)
        return len(self.value) - 1

    def done(self) -> Tree:
        for name in ("feature", "threshold", "left", "right", "value"):
            setattr(self, name, np.array(getattr(self, name)))
        return self

    def __call__(self, binned: np.ndarray) -> np.ndarray:
        at = np.zeros(len(binned), np.int64)
        rows = np.arange(len(binned))
        while True:
            feature = self.feature[at]
            inner = feature >= 0
            if not inner.any():
                return self.value[at]
            low = binned[rows, np.maximum(feature, 0)] <= self.threshold[at]
            at = np.where(inner, np.where(low, self.left[at], self.right[at]), at)


def grow(binned: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, depth: int, least: float, pick=None, smooth: float = 1.0) -> Tree:
    """A regression tree on gradients; `pick(n)` gives the features a node may use."""
    tree = Tree()
    n_features = binned.shape[1]

    def split(rows: np.ndarray, left: int) -> int:
        g, h = gradient[rows].sum(), hessian[rows].sum()
        node = tree.add(-g / (h + smooth))
        if left == 0 or h < 2 * least or len(rows) < 2:
            return node
        best = (1e-6, -1, 0)
        for k in range(n_features) if pick is None else pick(n_features):
            column = binned[rows, k]
            gs = np.cumsum(np.bincount(column, gradient[rows]))
            hs = np.cumsum(np.bincount(column, hessian[rows]))
            gain = gs**2 / (hs + smooth) + (g - gs) ** 2 / (h - hs + smooth) - g**2 / (h + smooth)
            gain[(hs < least) | (h - hs < least)] = -1
            cut = int(np.argmax(gain))
            if gain[cut] > best[0]:
                best = (gain[cut], k, cut)
        if best[1] >= 0:
            low = binned[rows, best[1]] <= best[2]
            tree.feature[node], tree.threshold[node] = best[1], best[2]
            tree.left[node] = split(rows[low], left - 1)
            tree.right[node] = split(rows[~low], left - 1)
        return node

    split(np.arange(len(binned)), depth)
    return tree.done()


class Boosted:
    """Gradient-boosted trees for log-odds."""

    def __init__(self, bins: Bins, base: float, trees: list[Tree]):
        self.bins, self.base, self.trees = bins, base, trees

    @classmethod
    def fit(cls, rows: np.ndarray, targets: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, weights: np.ndarray | None = None) -> Boosted:
        bins = Bins(rows)
        binned = bins(rows)
        weights = np.ones(len(rows)) if weights is None else weights
        share = np.clip(np.average(targets, weights=weights), 1e-3, 1 - 1e-3)
        base = float(np.log(share / (1 - share)))
        scores, trees = np.full(len(rows), base), []
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-scores))
            tree = grow(binned, weights * (p - targets), np.maximum(weights * p * (1 - p), 1e-6), depth, 1.0)
            tree.value = tree.value * rate
            trees.append(tree)
            scores += tree(binned)
        return cls(bins, base, trees)

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        binned = self.bins(rows)
        return self.base + sum(tree(binned) for tree in self.trees)


class Forest:
    """A random forest: each tree sees rows drawn with replacement and a few features at each node."""

    def __init__(self, bins: Bins, trees: list[Tree]):
        self.bins, self.trees = bins, trees

    @classmethod
    def fit(cls, rows: np.ndarray, targets: np.ndarray, trees: int = 40, depth: int = 8, seed: int = 7) -> Forest:
        rng = np.random.default_rng(seed)
        bins = Bins(rows)
        binned = bins(rows)
        few = max(1, round(np.sqrt(rows.shape[1])))
        grown = []
        for _ in range(trees):
            drawn = rng.integers(0, len(rows), len(rows))
            # with gradients of -target and hessians of 1 a leaf is the share of targets in it
            tree = grow(binned[drawn], -targets[drawn].astype(float), np.ones(len(drawn)), depth, 2.0, lambda n: rng.choice(n, min(n, 2 * few), replace=False), 1e-9)
            grown.append(tree)
        return cls(bins, grown)

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        binned = self.bins(rows)
        return sum(tree(binned) for tree in self.trees) / len(self.trees)
