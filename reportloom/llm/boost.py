"""Small gradient-boosted trees for binary labels, fitted on a bounded number of rows.

Fitting runs on the driver over at most some ten thousand feature rows (or over a table of
distinct feature rows with weights); scoring runs in tasks, or as a SQL expression.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Tree:
    """Arrays of a binary tree; a row goes left if its feature is at most the cut."""

    feature: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self) -> int:
        for column, blank in ((self.feature, -1), (self.cut, 0.0), (self.left, -1), (self.right, -1), (self.value, 0.0)):
            column.append(blank)
        return len(self.feature) - 1

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, cut, left, right, value = map(np.array, (self.feature, self.cut, self.left, self.right, self.value))
        at = np.zeros(len(x), int)
        rows = np.arange(len(x))
        while (feature[at] >= 0).any():
            inner = feature[at] >= 0
            down = x[rows, np.maximum(feature[at], 0)] <= cut[at]
            at = np.where(inner, np.where(down, left[at], right[at]), at)
        return value[at]

    def sql(self, names: list[str], node: int = 0) -> str:
        if self.feature[node] < 0:
            return f"{self.value[node]:.9f}D"
        return (
            f"CASE WHEN {names[self.feature[node]]} <= {self.cut[node]!r}D THEN "
            f"{self.sql(names, self.left[node])} ELSE {self.sql(names, self.right[node])} END"
        )


@dataclass
class Boosted:
    start: float
    trees: list[Tree]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for tree in self.trees:
            out += tree.predict(x)
        return out

    def sql(self, names: list[str]) -> str:
        """The margin as a sum of nested CASE expressions over ``names``."""
        return " + ".join([f"{self.start:.9f}D", *(f"({t.sql(names)})" for t in self.trees)])


def fit(
    x: np.ndarray,
    y: np.ndarray,
    weight: np.ndarray | None = None,
    trees: int = 60,
    depth: int = 3,
    rate: float = 0.2,
    bins: int = 32,
    ridge: float = 1.0,
    least: float = 5.0,
) -> Boosted:
    """Logistic boosting with histogram splits, second-order leaf values and a ridge."""
    w = np.ones(len(y)) if weight is None else weight.astype(float)
    total = w.sum()
    mean = np.clip((w * y).sum() / total if total else 0.5, 1e-3, 1 - 1e-3)
    model = Boosted(float(np.log(mean / (1 - mean))), [])
    if not len(y) or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    cuts = [np.unique(np.r_[c, np.unique(x[:, f])[:1]]) for f, c in enumerate(cuts)]
    level = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
    margin = np.full(len(y), model.start)
    for _ in range(trees):
        p = sigmoid(margin)
        g, h = w * (y - p), w * p * (1 - p)
        tree = Tree()
        todo = [(tree.add(), np.arange(len(y)), depth)]
        while todo:
            node, rows, deep = todo.pop()
            sg, sh = g[rows].sum(), h[rows].sum()
            tree.value[node] = float(rate * sg / (sh + ridge))
            best = (1e-6, -1, 0)
            for f in range(x.shape[1]) if deep else ():
                n = len(cuts[f]) + 1
                lg = np.cumsum(np.bincount(level[rows, f], g[rows], n))[:-1]
                lh = np.cumsum(np.bincount(level[rows, f], h[rows], n))[:-1]
                lw = np.cumsum(np.bincount(level[rows, f], w[rows], n))[:-1]
                gain = lg**2 / (lh + ridge) + (sg - lg) ** 2 / (sh - lh + ridge) - sg**2 / (sh + ridge)
                gain[(lw < least) | (w[rows].sum() - lw < least)] = 0
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), f, int(gain.argmax()))
            if best[1] >= 0:
                f, c = best[1:]
                down = level[rows, f] <= c
                tree.feature[node], tree.cut[node] = f, float(cuts[f][c])
                tree.left[node], tree.right[node] = tree.add(), tree.add()
                todo += [(tree.left[node], rows[down], deep - 1), (tree.right[node], rows[~down], deep - 1)]
        model.trees.append(tree)
        margin += tree.predict(x)
    return model


@dataclass
class Isotonic:
    """A non-decreasing step map from margins to probabilities, linear between its points."""

    at: np.ndarray
    value: np.ndarray

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        return np.interp(margin, self.at, self.value)


def isotonic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Isotonic:
    """Pool adjacent violators; end blocks keep half a count so no probability is 0 or 1."""
    if not len(y):
        return Isotonic(np.array([0.0]), np.array([0.0]))
    order = np.argsort(margin, kind="stable")
    w = np.ones(len(y)) if weight is None else weight
    blocks: list[list[float]] = []
    for i in order.tolist():
        blocks.append([w[i] * y[i], w[i], margin[i], margin[i]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, _, high = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = high
    at, value = [], []
    for s, n, low, high in blocks:
        p = (s + 0.5) / (n + 1) if s in (0, n) else s / n
        at += [low, high]
        value += [p, p]
    return Isotonic(np.array(at), np.maximum.accumulate(np.array(value)))
