"""Logistic regression: each round is one aggregation of gradient (and curvature) over the rows."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.errors import CollinearError, DivergedError
from corvane.functions.vectors import above, argmax, linear, logistic, softmax
from corvane.operators.linear import solve
from corvane.sources.model_store import persistable


@persistable
@dataclass
class LogisticModel:
    names: list[str]
    intercept: float
    weights: list[float]
    threshold: float = 0.5
    rounds: int = 0

    def score(self) -> Column:
        return linear(self.names, self.weights, self.intercept)

    def predict(self, df: DataFrame) -> DataFrame:
        """With probability and prediction (0.0 or 1.0)."""
        return df.withColumn("probability", logistic(self.score())).withColumn("prediction", above(F.col("probability"), self.threshold))

    def odds_multiplier(self, name: str) -> float:
        return math.exp(self.weights[self.names.index(name)])

    def boundary(self, name: str, others: dict[str, float]) -> float:
        """Where the feature crosses a probability of one half, the others held."""
        rest = self.intercept + sum(w * others[c] for c, w in zip(self.names, self.weights, strict=True) if c != name)
        return -rest / self.weights[self.names.index(name)]


def _columns(features: Sequence[str]) -> list[Column]:
    return [F.lit(1.0)] + [F.col(c).cast("double") for c in features]


def newton(df: DataFrame, features: Sequence[str], target: str, rounds: int = 100, tolerance: float = 1e-10, threshold: float = 0.5) -> LogisticModel:
    """Solves X'WX d = X'(y - p) until the step is small; perfectly separated classes are refused."""
    x, y = _columns(features), F.col(target).cast("double")
    p, b = len(x), np.zeros(len(x))
    for i in range(1, rounds + 1):
        q = logistic(linear(features, b[1:], b[0]))
        rows = df.select(q.alias("_q"), y.alias("_y"), *[c.alias(f"_x{k}") for k, c in enumerate(x)])
        w = F.col("_q") * (1 - F.col("_q"))
        sums = rows.agg(*[F.sum((F.col("_y") - F.col("_q")) * F.col(f"_x{k}")).alias(f"g{k}") for k in range(p)], *[F.sum(w * F.col(f"_x{k}") * F.col(f"_x{m}")).alias(f"h{k}_{m}") for k in range(p) for m in range(k + 1)]).first()
        g = np.array([sums[f"g{k}"] for k in range(p)])
        h = np.array([[sums[f"h{max(k, m)}_{min(k, m)}"] for m in range(p)] for k in range(p)])
        if h[0, 0] < 1e-9:
            raise DivergedError("the classes are separated")
        try:
            step = solve(h, g)
        except CollinearError as e:
            raise DivergedError("the curvature is singular") from e
        b = b + step
        if np.abs(step).max() < tolerance:
            return LogisticModel(list(features), float(b[0]), [float(v) for v in b[1:]], threshold, i)
    raise DivergedError("the steps don't settle")


def ascent(df: DataFrame, features: Sequence[str], target: str, rate: float = 0.1, epochs: int = 200, tolerance: float = 1e-8, threshold: float = 0.5) -> LogisticModel:
    """Steps of rate * X'(y - p) / n from zero; one pass over the rows an epoch."""
    x, y, b = _columns(features), F.col(target).cast("double"), np.zeros(len(features) + 1)
    for i in range(1, epochs + 1):
        q = logistic(linear(features, b[1:], b[0]))
        g = np.array(df.agg(*[F.avg((y - q) * c) for c in x]).first(), float)
        b = b + rate * g
        if np.linalg.norm(rate * g) < tolerance:
            break
    return LogisticModel(list(features), float(b[0]), [float(v) for v in b[1:]], threshold, i)


@persistable
@dataclass
class SoftmaxModel:
    """Class 0 has zero weights; rows: (intercept, weights...) of each class."""

    names: list[str]
    rows: np.ndarray
    rounds: int = 0

    def probabilities(self) -> Column:
        return softmax(F.array(*[linear(self.names, r[1:], r[0]) for r in self.rows]))

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn("probabilities", self.probabilities()).withColumn("prediction", argmax(F.col("probabilities")))


def multinomial(df: DataFrame, features: Sequence[str], target: str, n_classes: int, rounds: int = 50, tolerance: float = 1e-9) -> SoftmaxModel:
    """Newton's steps on all free classes together, one aggregation a round."""
    p, k = len(features) + 1, n_classes
    b = np.zeros((k, p))
    x = _columns(features)
    for i in range(1, rounds + 1):
        probabilities = softmax(F.array(*[linear(features, r[1:], r[0]) for r in b]))
        rows = df.select(probabilities.alias("_p"), F.col(target).cast("int").alias("_y"), *[c.alias(f"_x{j}") for j, c in enumerate(x)])
        q = [F.col("_p")[c] for c in range(k)]
        aggs = [F.sum((F.when(F.col("_y") == c, 1.0).otherwise(0.0) - q[c]) * F.col(f"_x{j}")).alias(f"g{c}_{j}") for c in range(1, k) for j in range(p)]
        aggs += [F.sum(q[c] * ((1.0 if c == d else 0.0) - q[d]) * F.col(f"_x{j}") * F.col(f"_x{m}")).alias(f"h{c}_{d}_{j}_{m}") for c in range(1, k) for d in range(1, c + 1) for j in range(p) for m in range(p)]
        row = rows.agg(*aggs).first()
        g = np.array([row[f"g{c}_{j}"] for c in range(1, k) for j in range(p)])
        h = np.zeros(((k - 1) * p, (k - 1) * p))
        for c in range(1, k):
            for d in range(1, c + 1):
                block = np.array([[row[f"h{c}_{d}_{j}_{m}"] for m in range(p)] for j in range(p)])
                h[(c - 1) * p : c * p, (d - 1) * p : d * p] = block
                h[(d - 1) * p : d * p, (c - 1) * p : c * p] = block.T
        step = solve(h, g).reshape(k - 1, p)
        b[1:] += step
        if not np.isfinite(b).all():
            raise DivergedError("the steps don't settle")
        if np.abs(step).max() < tolerance:
            break
    return SoftmaxModel(list(features), b, i)


@persistable
@dataclass
class OneVsRest:
    """One binary model a class; scores aren't normalised, the first greatest wins."""

    models: list[LogisticModel]

    def predict(self, df: DataFrame) -> DataFrame:
        out = df.withColumn("scores", F.array(*[logistic(m.score()) for m in self.models]))
        return out.withColumn("prediction", argmax(F.col("scores")))


def one_vs_rest(df: DataFrame, features: Sequence[str], target: str, n_classes: int, **options) -> OneVsRest:
    return OneVsRest([newton(df.withColumn("_is", (F.col(target) == c).cast("double")), features, "_is", **options) for c in range(n_classes)])
