"""Gradient boosted trees that become Spark SQL expressions.

Fitted on the driver from a small table of features; scoring is done by the
expression that ``Booster.probability`` writes, so no Python runs on executors.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

#: a leaf is a float, an inner node (feature, threshold, below or equal, above)
Tree = float | tuple


def _grow(x: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, l2: float) -> Tree:
    total_g, total_h = g[rows].sum(), h[rows].sum()
    best = (1e-6, None)
    if depth:
        for f, edges in enumerate(cuts):
            if not len(edges):
                continue
            at = np.searchsorted(edges, x[rows, f], "left")
            lg, lh = (np.cumsum(np.bincount(at, v[rows], len(edges) + 1))[:-1] for v in (g, h))
            gain = lg**2 / (lh + l2) + (total_g - lg) ** 2 / (total_h - lh + l2) - total_g**2 / (total_h + l2)
            gain[(lh < 0.5) | (total_h - lh < 0.5)] = 0
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (float(gain[i]), (f, float(edges[i])))
    if best[1] is None:
        return float(-total_g / (total_h + l2))
    f, edge = best[1]
    low = x[rows, f] <= edge
    return f, edge, _grow(x, cuts, g, h, rows[low], depth - 1, l2), _grow(x, cuts, g, h, rows[~low], depth - 1, l2)


def _apply(tree: Tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, edge, low, high = tree
    return np.where(x[:, f] <= edge, _apply(low, x), _apply(high, x))


def _sql(tree: Tree, feature: Callable[[int], str], rate: float) -> str:
    if not isinstance(tree, tuple):
        return f"{rate * tree!r}D"
    f, edge, low, high = tree
    return f"CASE WHEN {feature(f)} <= {edge!r}D THEN {_sql(low, feature, rate)} ELSE {_sql(high, feature, rate)} END"


@dataclass(frozen=True)
class Booster:
    trees: list[Tree]
    rate: float
    bias: float
    slope: float
    shift: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.bias + self.rate * sum((_apply(t, x) for t in self.trees), np.zeros(len(x)))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.raw(x) + self.shift)))

    def probability(self, feature: Callable[[int], str]) -> str:
        """The probability as SQL text over the texts of the features."""
        z = " + ".join([f"{self.bias!r}D", *(_sql(t, feature, self.rate) for t in self.trees)])
        return f"(1D / (1D + exp(-({self.slope!r}D * ({z}) + {self.shift!r}D))))"


def fit(x: np.ndarray, y: np.ndarray, held: np.ndarray, trees: int = 20, depth: int = 3, rate: float = 0.3, l2: float = 1.0) -> Booster:
    """Fit on the rows that aren't ``held`` and calibrate on those that are (Platt, by Newton's steps)."""
    xt, yt = x[~held], y[~held].astype(float)
    cuts = []
    for f in range(x.shape[1]):
        values = np.unique(xt[:, f])
        mids = (values[1:] + values[:-1]) / 2
        cuts.append(mids if len(mids) <= 32 else np.unique(np.quantile(xt[:, f], np.linspace(0.03, 0.97, 32))))
    mean = min(max(yt.mean(), 1e-3), 1 - 1e-3)
    bias = float(np.log(mean / (1 - mean)))
    z, grown = np.full(len(yt), bias), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        tree = _grow(xt, cuts, p - yt, p * (1 - p), np.arange(len(yt)), depth, l2)
        grown.append(tree)
        z = z + rate * _apply(tree, xt)
    model = Booster(grown, rate, bias, 1.0, 0.0)
    r, t = model.raw(x[held]), y[held].astype(float)
    t = np.where(t > 0, (t.sum() + 1) / (t.sum() + 2), 1 / ((1 - t).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * r + b)))
        d, w = p - t, np.maximum(p * (1 - p), 1e-6)
        grad = np.array([(d * r).sum() + 1e-3 * (a - 1), d.sum()])
        hess = np.array([[(w * r * r).sum() + 1e-3, (w * r).sum()], [(w * r).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return Booster(grown, rate, bias, float(a), float(b))


def threshold_for(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest threshold at which the wanted precision holds on (p, y); 0.5 at least."""
    order = np.argsort(-p, kind="stable")
    good = np.cumsum(y[order]) / np.arange(1, len(y) + 1) >= precision
    return max(0.5, float(p[order][np.flatnonzero(good)[-1]])) if good.any() else 1.0
