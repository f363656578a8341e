"""Principal components and truncated singular values: products summed over the rows, small solves."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.errors import ConstantColumnError
from corvane.functions.vectors import linear
from corvane.sources.model_store import persistable


@persistable
@dataclass
class PrincipalComponents:
    names: list[str]
    centre: np.ndarray
    spread: np.ndarray
    variances: np.ndarray
    loadings: np.ndarray  # a row a component; its largest entry is positive

    def transform(self, df: DataFrame, prefix: str = "pc") -> DataFrame:
        out = {}
        for k, row in enumerate(self.loadings):
            weights = row / self.spread
            out[f"{prefix}{k + 1}"] = linear(self.names, weights, float(-(weights * self.centre).sum()))
        return df.withColumns(out)

    def inverse(self, df: DataFrame, prefix: str = "pc") -> DataFrame:
        parts = [f"{prefix}{k + 1}" for k in range(len(self.loadings))]
        return df.withColumns({c: linear(parts, self.loadings[:, j] * self.spread[j], float(self.centre[j])) for j, c in enumerate(self.names)})

    def shares(self, total: float | None = None) -> np.ndarray:
        return self.variances / (total or self.variances.sum())


def principal_components(df: DataFrame, features: Sequence[str], n: int | None = None, standardize: bool = False) -> PrincipalComponents:
    """Eigenvectors of the sample covariance (over n - 1), greatest variance first."""
    p = len(features)
    x = [F.col(c).cast("double") for c in features]
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(x)], *[F.covar_samp(x[i], x[j]).alias(f"c{i}_{j}") for i in range(p) for j in range(i + 1)]).first()
    spread = np.array([row[f"s{i}"] for i in range(p)]) if standardize else np.ones(p)
    if (spread == 0).any():
        raise ConstantColumnError("a column doesn't vary")
    cov = np.array([[row[f"c{max(i, j)}_{min(i, j)}"] for j in range(p)] for i in range(p)]) / np.outer(spread, spread)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][: n or p]
    loadings = vectors[:, order].T
    signs = np.sign(loadings[np.arange(len(order)), np.abs(loadings).argmax(1)])
    return PrincipalComponents(list(features), np.array([row[f"m{i}"] for i in range(p)]), spread, np.maximum(values[order], 0), loadings * signs[:, None])


def kernel_components(gram: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(variances, projections) of a bounded set of points from its kernel matrix, centred twice."""
    k = gram - gram.mean(0) - gram.mean(1)[:, None] + gram.mean()
    values, vectors = np.linalg.eigh(k)
    order = np.argsort(values)[::-1][:n]
    values = np.maximum(values[order], 0)
    return values / len(gram), vectors[:, order] * np.sqrt(values)


def truncated_svd(matrix: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """U, s, V'; the largest entry of each column of U is positive."""
    u, s, vt = np.linalg.svd(matrix, full_matrices=False)
    u, s, vt = u[:, :n], s[:n], vt[:n]
    signs = np.sign(u[np.abs(u).argmax(0), np.arange(len(s))])
    signs[signs == 0] = 1
    return u * signs, s, vt * signs[:, None]


def hebbian_components(points: np.ndarray, n: int = 1, epochs: int = 200, start: float = 0.05, end: float = 5e-4, seed: int = 0) -> np.ndarray:
    """Components of a bounded sample by Sanger's rule: w_k += rate * y_k (x - sum of y_j w_j, j <= k)."""
    draw = np.random.default_rng(seed)
    x = points - points.mean(0)
    w = draw.normal(size=(n, x.shape[1]))
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    for epoch in range(epochs):
        rate = start * (end / start) ** (epoch / max(epochs - 1, 1))
        for row in x[draw.permutation(len(x))]:
            y = w @ row
            w += rate * (np.outer(y, row) - np.tril(np.outer(y, y)) @ w)
    return w / np.linalg.norm(w, axis=1, keepdims=True)


def hopfield_weights(patterns: DataFrame, units: Sequence[str]) -> np.ndarray:
    """Hebb's rule over rows of -1 and 1: sums of products over the number of units, no self-link."""
    p = len(units)
    row = patterns.agg(*[F.sum(F.col(units[i]) * F.col(units[j])).alias(f"w{i}_{j}") for i in range(p) for j in range(i)]).first()
    out = np.zeros((p, p))
    for i in range(p):
        for j in range(i):
            out[i, j] = out[j, i] = row[f"w{i}_{j}"] / p
    return out


def hopfield_recall(weights: np.ndarray, state: np.ndarray, passes: int = 20, together: bool = False) -> np.ndarray:
    """The state that the network settles in; a unit without drive keeps its sign."""
    now = np.array(state, float)
    for _ in range(passes):
        before = now.copy()
        if together:
            drive = weights @ now
            now = np.where(drive == 0, now, np.sign(drive))
        else:
            for i in range(len(now)):
                drive = weights[i] @ now
                now[i] = now[i] if drive == 0 else np.sign(drive)
        if (now == before).all():
            break
    return now


def hopfield_energy(weights: np.ndarray, state: np.ndarray) -> float:
    return float(-0.5 * state @ weights @ state)
