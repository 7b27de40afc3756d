"""Histogram gradient-boosted trees for a binary label, in numpy; small models over bounded samples."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    """Nodes in order of making: go left where x[feature] <= cut; a leaf has feature -1."""

    feature: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        for column, x in ((self.feature, -1), (self.cut, 0.0), (self.left, -1), (self.right, -1), (self.value, value)):
            column.append(x)
        return len(self.value) - 1

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, cut, left, right = (np.array(c) for c in (self.feature, self.cut, self.left, self.right))
        at = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(feature[at] >= 0)
            if not len(inner):
                return np.array(self.value)[at]
            node = at[inner]
            at[inner] = np.where(x[inner, feature[node]] <= cut[node], left[node], right[node])

    def paths(self) -> list[tuple[tuple[int, float, bool], ...]]:
        """Conditions (feature, cut, whether <=) on the way to each node but the root."""
        out: list[tuple] = []
        stack: list[tuple[int, tuple]] = [(0, ())]
        while stack:
            node, path = stack.pop()
            if path:
                out.append(path)
            if self.feature[node] >= 0:
                f, c = self.feature[node], self.cut[node]
                stack += [(self.left[node], (*path, (f, c, True))), (self.right[node], (*path, (f, c, False)))]
        return out


@dataclass
class Boosted:
    base: float
    trees: list[Tree]

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += t.predict(x)
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 10, penalty: float = 1.0, subsample: float = 0.7, columns: float = 0.7, weight: np.ndarray | None = None, seed: int = 7) -> Boosted:
    """Second-order boosting of the logistic loss. Cuts stand halfway between neighbouring values, so equal inputs give equal sides."""
    r = np.random.default_rng(seed)
    n, m = x.shape
    w = np.ones(n) if weight is None else weight
    p = float(np.clip((w * y).sum() / w.sum(), 1e-6, 1 - 1e-6))
    model = Boosted(float(np.log(p / (1 - p))), [])
    cuts, binned = [], np.zeros((n, m), np.int64)
    for f in range(m):
        values = np.unique(x[:, f])
        if len(values) > bins:
            values = np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins), method="nearest"))
        cuts.append((values[:-1] + values[1:]) / 2)
        binned[:, f] = np.searchsorted(cuts[f], x[:, f], side="left")
    logit = np.full(n, model.base)
    for _ in range(rounds):
        prob = 1 / (1 + np.exp(-logit))
        grad, hess = w * (prob - y), w * np.maximum(prob * (1 - prob), 1e-9)
        rows = np.flatnonzero(r.random(n) < subsample) if subsample < 1 else np.arange(n)
        if not len(rows):
            continue
        use = np.sort(r.choice(m, max(1, round(columns * m)), replace=False))
        tree = Tree()
        work = [(tree.add(0.0), rows, 0)]
        while work:
            node, own, level = work.pop()
            g, h = grad[own].sum(), hess[own].sum()
            tree.value[node] = float(-rate * g / (h + penalty))
            if level == depth or len(own) < 2 * least:
                continue
            best = (1e-6, -1, -1)
            for f in use:
                k = len(cuts[f])
                if not k:
                    continue
                b = binned[own, f]
                gl = np.cumsum(np.bincount(b, grad[own], k + 1))[:-1]
                hl = np.cumsum(np.bincount(b, hess[own], k + 1))[:-1]
                nl = np.cumsum(np.bincount(b, minlength=k + 1))[:-1]
                gain = gl**2 / (hl + penalty) + (g - gl) ** 2 / (h - hl + penalty) - g**2 / (h + penalty)
                gain[(nl < least) | (len(own) - nl < least)] = -1
                j = int(gain.argmax())
                if gain[j] > best[0]:
                    best = (float(gain[j]), int(f), j)
            _, f, j = best
            if f < 0:
                continue
            go = binned[own, f] <= j
            tree.feature[node], tree.cut[node] = f, float(cuts[f][j])
            tree.left[node], tree.right[node] = tree.add(0.0), tree.add(0.0)
            work += [(tree.left[node], own[go], level + 1), (tree.right[node], own[~go], level + 1)]
        model.trees.append(tree)
        logit += tree.predict(x)
    return model
