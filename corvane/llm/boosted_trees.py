"""Gradient-boosted trees for the logistic loss on small numeric tables, with numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    feature: list[int] = field(default_factory=list)  # -1: a leaf
    cut: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def node(self, value: float) -> int:
        for part, x in ((self.feature, -1), (self.cut, 0.0), (self.left, -1), (self.right, -1), (self.value, value)):
            part.append(x)
        return len(self.value) - 1

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        feature, cut, left, right = (np.array(p) for p in (self.feature, self.cut, self.left, self.right))
        while (inner := feature[at] >= 0).any():
            rows = np.flatnonzero(inner)
            node = at[rows]
            at[rows] = np.where(x[rows, feature[node]] <= cut[node], left[node], right[node])
        return np.array(self.value)[at]


def _grow(tree: Tree, x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, least: float, penalty: float) -> int:
    node = tree.node(-g.sum() / (h.sum() + penalty))
    if depth == 0:
        return node
    best, total_g, total_h = (1e-9, -1, 0.0), g.sum(), h.sum()
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        v, lg, lh = x[order, j], np.cumsum(g[order])[:-1], np.cumsum(h[order])[:-1]
        gain = lg**2 / (lh + penalty) + (total_g - lg) ** 2 / (total_h - lh + penalty) - total_g**2 / (total_h + penalty)
        gain[(v[1:] <= v[:-1]) | (lh < least) | (total_h - lh < least)] = -1
        if len(gain) and gain.max() > best[0]:
            at = int(gain.argmax())
            best = (float(gain[at]), j, float((v[at] + v[at + 1]) / 2))
    _, j, cut = best
    if j >= 0:
        low = x[:, j] <= cut
        tree.feature[node], tree.cut[node] = j, cut
        tree.left[node] = _grow(tree, x[low], g[low], h[low], depth - 1, least, penalty)
        tree.right[node] = _grow(tree, x[~low], g[~low], h[~low], depth - 1, least, penalty)
    return node


@dataclass
class Model:
    start: float
    trees: list[Tree]
    rate: float
    slope: float = 1.0
    offset: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.start + self.rate * sum((t.predict(x) for t in self.trees), np.zeros(len(x)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Calibrated on rows that no tree saw."""
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(x) + self.offset, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.2, least: float = 2.0, penalty: float = 1.0) -> Model:
    """Every third row is left out of the trees and calibrates their sum (Platt's scaling)."""
    held = np.arange(len(y)) % 3 == 2
    xs, ys = x[~held], y[~held]
    share = float(np.clip(ys.mean(), 1e-3, 1 - 1e-3))
    model = Model(float(np.log(share / (1 - share))), [], rate)
    score = np.full(len(ys), model.start)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree = Tree()
        _grow(tree, xs, p - ys, p * (1 - p), depth, least, penalty)
        model.trees.append(tree)
        score = score + rate * tree.predict(xs)
    raw, target = model.raw(x[held]), y[held]
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton's steps, with a little weight on the start
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        grad = np.array([((p - target) * raw).sum() + (a - 1), (p - target).sum() + b * 1e-3])
        hess = np.array([[(w * raw * raw).sum() + 1, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    model.slope, model.offset = float(max(a, 1e-3)), float(b)
    return model
