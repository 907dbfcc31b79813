"""Gradient boosted trees for binary labels, in numpy, with calibrated probabilities."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Nodes lie as in a heap; a node with feature -1 passes its rows to its left child."""
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        depth = int(np.log2(len(self.value) + 1)) - 1
        for _ in range(depth):
            f = self.feature[at]
            right = (f >= 0) & (x[rows, np.maximum(f, 0)] > self.threshold[at])
            at = 2 * at + 1 + right
        return self.value[at]


@dataclass
class Boosted:
    """Sum of trees, then Platt's scaling a * score + b."""

    base: float = 0.0
    rate: float = 0.15
    trees: list[Tree] = field(default_factory=list)
    scale: tuple[float, float] = (1.0, 0.0)
    threshold: float = 0.5

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += self.rate * t.predict(x)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.score(x) + b, -40, 40)))


    def to_dict(self) -> dict:
        """Plain numbers, for JSON; fractions are rounded to what the trees need."""
        trees = [{"feature": t.feature.tolist(), "threshold": [float(f"{x:.6g}") for x in t.threshold], "value": [float(f"{x:.5g}") for x in t.value]} for t in self.trees]
        return {"base": self.base, "rate": self.rate, "scale": list(self.scale), "threshold": self.threshold, "trees": trees}

    @classmethod
    def from_dict(cls, d: dict) -> Boosted:
        trees = [Tree(np.array(t["feature"]), np.array(t["threshold"], float), np.array(t["value"], float)) for t in d["trees"]]
        return cls(d["base"], d["rate"], trees, tuple(d["scale"]), d["threshold"])


def _grow(bins: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, least: float, l2: float) -> Tree:
    """bins: per row and feature its bin, offset so that the bins of all features lie in one range."""
    n_nodes = 2 ** (depth + 1) - 1
    feature, threshold, value = np.full(n_nodes, -1), np.zeros(n_nodes), np.zeros(n_nodes)
    node = np.zeros(len(g), np.int64)
    n_features, width = len(cuts), max(len(c) for c in cuts) + 1
    real = np.arange(width)[None, :] < np.array([len(c) for c in cuts])[:, None]
    for level in range(depth):
        first = 2**level - 1
        for k in range(first, 2 * first + 1):
            own = np.flatnonzero(node == k)
            if not len(own):
                continue
            gs, hs = g[own].sum(), h[own].sum()
            flat = bins[own].ravel()
            gl = np.bincount(flat, np.repeat(g[own], n_features), n_features * width).reshape(n_features, width).cumsum(axis=1)
            hl = np.bincount(flat, np.repeat(h[own], n_features), n_features * width).reshape(n_features, width).cumsum(axis=1)
            gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
            gain = np.where(real & (hl >= least) & (hs - hl >= least), gain, -1)
            f, i = np.unravel_index(int(gain.argmax()), gain.shape)
            if gain[f, i] > 1e-6:
                feature[k], threshold[k] = f, cuts[f][i]
                node[own] = 2 * k + 1 + (bins[own, f] - f * width > i)
            else:
                node[own] = 2 * k + 1
    leaves = 2**depth - 1
    gs, hs = np.bincount(node, g, n_nodes), np.bincount(node, h, n_nodes)
    value[leaves:] = (-gs / (hs + l2))[leaves:]
    return Tree(feature, threshold, value)


def _platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a logistic curve through the scores, by Newton's method with halved steps. Labels are smoothed by the counts
    of either class, so that classes which are wholly apart have a finite solution."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))

    def loss(a: float, b: float) -> float:
        z = a * score + b
        return float((np.logaddexp(0, z) - target * z).sum())

    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * score + b, -40, 40)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - target) * score).sum(), (p - target).sum()])
        m = np.array([[(w * score * score).sum(), (w * score).sum()], [(w * score).sum(), w.sum()]]) + 1e-6 * np.eye(2)
        step, size, now = np.linalg.solve(m, g), 1.0, loss(a, b)
        while size > 1e-6 and loss(a - size * step[0], b - size * step[1]) > now:
            size /= 2
        a, b = a - size * step[0], b - size * step[1]
        if np.abs(size * step).max() < 1e-6:
            break
    return float(a), float(b)


def fit(x: np.ndarray, y: np.ndarray, held: np.ndarray, rounds: int = 90, depth: int = 5, bins: int = 24) -> Boosted:
    """Trees from the rows outside held; calibration and the threshold, the one nearest to even odds of those with about the greatest F1, from the rows in held."""
    xt, yt = x[~held], y[~held].astype(float)
    cuts = []
    for f in range(x.shape[1]):
        u = np.unique(xt[:, f])
        c = (u[1:] + u[:-1]) / 2
        cuts.append(c if len(c) < bins else np.unique(np.quantile(xt[:, f], np.linspace(0, 1, bins + 1)[1:-1])))
    width = max(len(c) for c in cuts) + 1
    binned = np.stack([np.searchsorted(c, xt[:, f], side="left") + f * width for f, c in enumerate(cuts)], axis=1)
    p0 = float(np.clip(yt.mean(), 1e-3, 1 - 1e-3))
    model = Boosted(base=float(np.log(p0 / (1 - p0))))
    s = np.full(len(yt), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-s))
        tree = _grow(binned, cuts, p - yt, np.maximum(p * (1 - p), 1e-6), depth, 1.0, 1.0)
        model.trees.append(tree)
        s += model.rate * tree.predict(xt)
    model.scale = _platt(model.score(x[held]), y[held].astype(float))
    p, true = model.probability(x[held]), y[held] == 1
    steps = np.linspace(0.05, 0.95, 91)
    f1 = np.array([2 * ((p >= t) & true).sum() / max(1, (p >= t).sum() + true.sum()) for t in steps])
    # Many thresholds do about equally well; of these the one nearest to even odds is the least tuned to the held rows.
    good = steps[f1 >= f1.max() - 0.003]
    model.threshold = float(good[np.abs(good - 0.5).argmin()])
    return model
