"""Generative classifiers: class statistics by one grouped aggregation, scores as projections."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.errors import CollinearError
from corvane.functions.vectors import argmax, softmax
from corvane.sources.model_store import persistable


@dataclass
class ClassMoments:
    n: np.ndarray
    mean: np.ndarray  # (K, p)
    product: np.ndarray  # (K, p, p): means of products

    @classmethod
    def of(cls, df: DataFrame, features: Sequence[str], label: str) -> ClassMoments:
        p = len(features)
        x = [F.col(c).cast("double") for c in features]
        rows = df.groupBy(F.col(label).cast("int").alias("k")).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)], *[F.covar_pop(x[i], x[j]).alias(f"c{i}_{j}") for i in range(p) for j in range(i + 1)]).orderBy("k").collect()
        cov = np.array([[[r[f"c{max(i, j)}_{min(i, j)}"] for j in range(p)] for i in range(p)] for r in rows], float)
        return cls(np.array([r["n"] for r in rows], float), np.array([[r[f"m{i}"] for i in range(p)] for r in rows], float), cov)


@persistable
@dataclass
class QuadraticScores:
    """score_k = constant_k + linear_k . x + x' quadratic_k x; classes by the greatest, softmax as probabilities."""

    names: list[str]
    constant: np.ndarray
    linear: np.ndarray
    quadratic: np.ndarray

    def scores(self) -> Column:
        x = [F.col(c).cast("double") for c in self.names]
        out = []
        for c, b, q in zip(self.constant, self.linear, self.quadratic, strict=True):
            s = F.lit(float(c))
            for i, v in enumerate(x):
                s = s + F.lit(float(b[i])) * v
                for j in range(i + 1):
                    w = float(q[i, j] + q[j, i]) if i != j else float(q[i, i])
                    if w:
                        s = s + F.lit(w) * v * x[j]
            out.append(s)
        return F.array(*out)

    def predict(self, df: DataFrame) -> DataFrame:
        out = df.withColumn("scores", self.scores())
        return out.withColumn("probabilities", softmax(F.col("scores"))).withColumn("prediction", argmax(F.col("scores")))


def _from_precision(names, prior, mean, precision, log_det) -> QuadraticScores:
    constant = [math.log(w) - 0.5 * (d + m @ q @ m) for w, m, q, d in zip(prior, mean, precision, log_det, strict=True)]
    return QuadraticScores(list(names), np.array(constant), np.array([q @ m for m, q in zip(mean, precision, strict=True)]), np.array([-0.5 * q for q in precision]))


def _inverse(cov: np.ndarray) -> tuple[np.ndarray, float]:
    if np.linalg.matrix_rank(cov) < len(cov):
        raise CollinearError("a class's covariance is singular")
    return np.linalg.inv(cov), float(np.linalg.slogdet(cov)[1])


def gaussian_naive_bayes(df: DataFrame, features: Sequence[str], label: str, smoothing: float = 1e-9) -> QuadraticScores:
    """Population variances, raised by smoothing times the largest variance of a column over all rows."""
    m = ClassMoments.of(df, features, label)
    largest = max(df.agg(*[F.var_pop(F.col(c).cast("double")) for c in features]).first())
    variance = np.array([np.diag(c) for c in m.product]) + smoothing * largest
    return _from_precision(features, m.n / m.n.sum(), m.mean, [np.diag(1 / v) for v in variance], [float(np.log(v).sum()) for v in variance])


def linear_discriminant(df: DataFrame, features: Sequence[str], label: str) -> QuadraticScores:
    """One covariance for all classes, over n - K."""
    m = ClassMoments.of(df, features, label)
    pooled = (m.n[:, None, None] * m.product).sum(axis=0) / (m.n.sum() - len(m.n))
    q, d = _inverse(pooled)
    full = _from_precision(features, m.n / m.n.sum(), m.mean, [q] * len(m.n), [d] * len(m.n))
    return QuadraticScores(full.names, full.constant, full.linear, np.zeros_like(full.quadratic))


def quadratic_discriminant(df: DataFrame, features: Sequence[str], label: str, shrinkage: float = 0.0) -> QuadraticScores:
    """A covariance for each class over n_k - 1, drawn to the unit matrix by ``shrinkage``."""
    m = ClassMoments.of(df, features, label)
    own = [(1 - shrinkage) * c * n / (n - 1) + shrinkage * np.eye(len(features)) for c, n in zip(m.product, m.n, strict=True)]
    found = [_inverse(c) for c in own]
    return _from_precision(features, m.n / m.n.sum(), m.mean, [q for q, _ in found], [d for _, d in found])


@persistable
@dataclass
class DiagonalGaussian:
    """One Gaussian of independent columns: density of rows, and samples from it."""

    names: list[str]
    mean: np.ndarray
    variance: np.ndarray

    @classmethod
    def of(cls, df: DataFrame, features: Sequence[str], least: float = 1e-12) -> DiagonalGaussian:
        x = [F.col(c).cast("double") for c in features]
        row = df.agg(*[F.avg(c) for c in x], *[F.var_pop(c) for c in x]).first()
        p = len(features)
        return cls(list(features), np.array(row[:p], float), np.maximum(np.array(row[p:], float), least))

    def log_density(self) -> Column:
        out = F.lit(float(-0.5 * np.log(2 * math.pi * self.variance).sum()))
        for c, m, v in zip(self.names, self.mean, self.variance, strict=True):
            out = out - (F.col(c) - float(m)) * (F.col(c) - float(m)) / float(2 * v)
        return out

    def sample(self, n: int, seed: int = 0) -> np.ndarray:
        return np.random.default_rng(seed).normal(self.mean, np.sqrt(self.variance), (n, len(self.names)))


@persistable
@dataclass
class LinearAutoencoder:
    """Given weights: codes are encoder x, outputs decoder code."""

    names: list[str]
    encoder: np.ndarray  # (codes, features)
    decoder: np.ndarray  # (features, codes)

    def transform(self, df: DataFrame) -> DataFrame:
        """With codes, output (arrays) and error, the mean squared difference from the input."""
        x = [F.col(c).cast("double") for c in self.names]
        mixed = lambda rows, values: F.array(*[sum((v * float(w) for w, v in zip(row, values, strict=True)), F.lit(0.0)) for row in rows])
        out = df.withColumn("codes", mixed(self.encoder, x))
        out = out.withColumn("output", mixed(self.decoder, [F.col("codes")[i] for i in range(len(self.encoder))]))
        return out.withColumn("error", sum(((v - F.col("output")[i]) * (v - F.col("output")[i]) for i, v in enumerate(x)), F.lit(0.0)) / len(x))


@persistable
@dataclass
class AdversarialGaussian:
    """A generator z + mean against a logistic judge of one number, in alternating gradient steps."""

    mean: float = -1.5
    weight: float = 0.0
    bias: float = 0.0

    def judged(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.weight * x + self.bias)))

    def step(self, real: np.ndarray, noise: np.ndarray, rate: float) -> None:
        """The judge climbs log D(real) + log(1 - D(fake)), then the generator log D(fake)."""
        fake = noise + self.mean
        right, wrong = 1 - self.judged(real), self.judged(fake)
        self.weight += rate * float((right * real).mean() - (wrong * fake).mean())
        self.bias += rate * float(right.mean() - wrong.mean())
        self.mean += rate * float(((1 - self.judged(fake)) * self.weight).mean())
