"""Linear regression from sufficient statistics: one pass over the rows, then small solves.

``Moments`` holds the sums of products of features and target. Ordinary, ridge, lasso, elastic-net
and gradient-descent fits all start from it, so a grid over penalties costs one pass in all.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.errors import CollinearError, ConstantColumnError, DivergedError, EmptyInputError, NameMismatchError, UndefinedMetricError
from corvane.functions.vectors import linear
from corvane.sources.model_store import persistable


@dataclass
class Moments:
    """Of the columns [1, features...] and the target; the ones column is left out without intercept."""

    names: list[str]
    intercept: bool
    n: float
    xx: np.ndarray
    xy: np.ndarray
    yy: float

    @classmethod
    def of(cls, df: DataFrame, features: Sequence[str], target: str, intercept: bool = True, weight=None) -> Moments:
        w = F.lit(1.0) if weight is None else weight
        x = ([F.lit(1.0)] if intercept else []) + [F.col(c).cast("double") for c in features]
        y = F.col(target).cast("double")
        p = len(x)
        aggs = [F.sum(w * x[i] * x[j]).alias(f"x_{i}_{j}") for i in range(p) for j in range(i + 1)]
        row = df.agg(F.count("*").alias("n"), F.sum(w * y * y).alias("yy"), *[F.sum(w * x[i] * y).alias(f"y_{i}") for i in range(p)], *aggs).first()
        if not row["n"]:
            raise EmptyInputError("no rows to fit")
        xx = np.array([[row[f"x_{max(i, j)}_{min(i, j)}"] for j in range(p)] for i in range(p)], float)
        return cls(list(features), intercept, float(row["n"]), xx, np.array([row[f"y_{i}"] for i in range(p)], float), float(row["yy"]))

    @property
    def exempt(self) -> np.ndarray:
        """1 where a coefficient is penalised; the intercept isn't."""
        out = np.ones(len(self.xy))
        if self.intercept:
            out[0] = 0.0
        return out

    def r2(self, model: LinearModel) -> float:
        """Of a model on these rows, as what it explains over the total: 1 - rss / tss would keep sixteen digits
        after the point, and the scores of near models often differ in later ones."""
        if not self.intercept or model.names != self.names:
            raise NameMismatchError("moments with an intercept, of the model's features, are needed")
        n, w = self.xx[0, 0], np.array(model.weights)
        x, y = self.xx[0, 1:] / n, self.xy[0] / n
        total = self.yy - n * y * y
        if not total > 1e-12 * self.yy:
            raise UndefinedMetricError("r2 has a zero denominator")
        off = y - model.intercept - w @ x
        explained = 2 * w @ (self.xy[1:] - n * x * y) - w @ (self.xx[1:, 1:] - n * np.outer(x, x)) @ w - n * off * off
        return float(explained / total)


@persistable
@dataclass
class LinearModel:
    names: list[str]
    intercept: float
    weights: list[float]
    rounds: int = 0

    def score(self):
        return linear(self.names, self.weights, self.intercept)

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return df.withColumn(name, self.score())


def _model(m: Moments, b: np.ndarray, rounds: int = 0) -> LinearModel:
    b = np.asarray(b, float)
    return LinearModel(m.names, float(b[0]) if m.intercept else 0.0, [float(v) for v in b[int(m.intercept):]], rounds)


def solve(system: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Refuses a system that is singular to working precision."""
    scale = np.sqrt(np.maximum(np.abs(np.diag(system)), 1e-300))
    even = system / np.outer(scale, scale)
    if np.linalg.matrix_rank(even, tol=1e-12 * len(even)) < len(even):
        raise CollinearError("the columns depend on each other")
    return np.linalg.solve(even, target / scale) / scale


def simple(df: DataFrame, feature: str, target: str) -> LinearModel:
    row = df.agg(F.regr_slope(target, feature).alias("b"), F.regr_intercept(target, feature).alias("a")).first()
    if row["b"] is None:
        raise ConstantColumnError(f"{feature} doesn't vary")
    return LinearModel([feature], row["a"], [row["b"]])


def ordinary(m: Moments) -> LinearModel:
    return _model(m, solve(m.xx, m.xy))


def ridge(m: Moments, penalty: float = 1.0) -> LinearModel:
    """Least |y - Xb|^2 + penalty |b|^2."""
    return _model(m, solve(m.xx + penalty * np.diag(m.exempt), m.xy))


def gradient_descent(m: Moments, rate: float = 0.01, epochs: int = 10_000, tolerance: float = 1e-8) -> LinearModel:
    """Steps of -rate * 2 / n * (X'Xb - X'y) from zero, which the moments give without the rows."""
    b = np.zeros(len(m.xy))
    for i in range(1, epochs + 1):
        with np.errstate(over="ignore", invalid="ignore"):
            step = rate * 2.0 / m.n * (m.xy - m.xx @ b)
            b = b + step
        if not np.isfinite(b).all():
            raise DivergedError("the rate is too large")
        if np.linalg.norm(step) < tolerance:
            return _model(m, b, i)
    return _model(m, b, epochs)


def elastic_net(m: Moments, penalty: float = 1.0, l1_share: float = 0.5, rounds: int = 1000, tolerance: float = 1e-10) -> LinearModel:
    """Least |y - Xb|^2 + penalty * (share |b|_1 + (1 - share) |b|^2), by coordinates on the moments."""
    b = np.zeros(len(m.xy))
    l1, l2 = penalty * l1_share / 2 * m.exempt, penalty * (1 - l1_share) * m.exempt
    for i in range(1, rounds + 1):
        largest = 0.0
        for j in range(len(b)):
            rho = m.xy[j] - m.xx[j] @ b + m.xx[j, j] * b[j]
            bottom = m.xx[j, j] + l2[j]
            new = np.sign(rho) * max(abs(rho) - l1[j], 0.0) / bottom if bottom else 0.0
            largest = max(largest, abs(new - b[j]))
            b[j] = new
        if largest < tolerance:
            return _model(m, b, i)
    return _model(m, b, rounds)


def lasso(m: Moments, penalty: float = 1.0, rounds: int = 1000, tolerance: float = 1e-10) -> LinearModel:
    return elastic_net(m, penalty, 1.0, rounds, tolerance)


def huber(df: DataFrame, features: Sequence[str], target: str, threshold: float = 1.35, penalty: float = 0.0, rounds: int = 100, tolerance: float = 1e-8) -> LinearModel:
    """Weighted least squares round by round, one aggregation each; the scale is estimated jointly:
    s^2 = (squared residuals inside t s) / (n - t^2 * number outside)."""
    m = Moments.of(df, features, target)
    model = ridge(m, penalty) if penalty else ordinary(m)
    b = np.array([model.intercept, *model.weights])
    scale = float(np.sqrt(max(m.yy - 2 * b @ m.xy + b @ m.xx @ b, 0.0) / m.n)) or 1.0
    for i in range(1, rounds + 1):
        r = F.abs(F.col(target) - model.score())
        row = df.agg(F.sum(F.when(r <= threshold * scale, r * r)).alias("inside"), F.count_if(r > threshold * scale).alias("outside"), F.count("*").alias("n")).first()
        left = row["n"] - threshold**2 * row["outside"]
        if left > 0 and row["inside"]:
            scale = float(np.sqrt(row["inside"] / left))
        weight = F.when(r <= threshold * scale, 1.0).otherwise(threshold * scale / r)
        new = Moments.of(df, features, target, weight=weight)
        after = ridge(new, penalty * scale) if penalty else ordinary(new)
        moved = np.abs(np.array([after.intercept, *after.weights]) - np.array([model.intercept, *model.weights])).max()
        model = after
        if moved < tolerance:
            break
    model.rounds = i
    return model
