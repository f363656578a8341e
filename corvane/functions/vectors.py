"""Column expressions on arrays of doubles: distances, kernels, activations, losses, impurities, hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x * y).cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: ((x - y) * (x - y)).cast("double")))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def minkowski(a: Column, b: Column, p: float) -> Column:
    """Manhattan at 1, Chebyshev at infinity."""
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double"))
    if p == float("inf"):
        return F.array_max(gaps)
    return F.pow(total(F.transform(gaps, lambda g: F.pow(g, F.lit(float(p))))), F.lit(1.0 / p))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 minus the cosine, in [0, 2]; a row of zeros counts as having the norm 1."""
    guard = lambda v: F.when(norm(v) == 0, F.lit(1.0)).otherwise(norm(v))
    return F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1 - dot(a, b) / (guard(a) * guard(b))))


def hamming(a: Column, b: Column) -> Column:
    """The share of places that differ."""
    return total(F.zip_with(a, b, lambda x, y: (x != y).cast("double"))) / F.size(a)


def canberra(a: Column, b: Column) -> Column:
    part = lambda x, y: F.when(F.abs(x) + F.abs(y) == 0, F.lit(0.0)).otherwise(F.abs(x - y) / (F.abs(x) + F.abs(y)))
    return total(F.zip_with(a, b, part))


DISTANCES = {"euclidean": euclidean, "manhattan": lambda a, b: minkowski(a, b, 1), "chebyshev": lambda a, b: minkowski(a, b, float("inf")), "cosine": cosine_distance, "hamming": hamming, "canberra": canberra}


def linear_kernel(a: Column, b: Column) -> Column:
    return dot(a, b)


def polynomial_kernel(a: Column, b: Column, degree: int = 3, gamma: float = 1.0, constant: float = 1.0) -> Column:
    return F.pow(dot(a, b) * gamma + constant, F.lit(degree))


def radial_kernel(a: Column, b: Column, gamma: float = 1.0) -> Column:
    return F.exp(squared_distance(a, b) * -gamma)


def sigmoid_kernel(a: Column, b: Column, gamma: float = 1.0, constant: float = 0.0) -> Column:
    return F.tanh(dot(a, b) * gamma + constant)


def linear(columns: Sequence[str], weights: Sequence[float], intercept: float = 0.0) -> Column:
    """The projection that a linear model predicts with."""
    out = F.lit(float(intercept))
    for c, w in zip(columns, weights, strict=True):
        out = out + F.col(c) * F.lit(float(w))
    return out


def logistic(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def softmax(scores: Column) -> Column:
    """Of an array; the largest is taken off first, so nothing overflows."""
    shifted = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    return F.transform(shifted, lambda e: e / total(shifted))


def log_total(scores: Column) -> Column:
    """log(sum(exp(s))) of an array, the largest taken off first; of nothing but minus infinity, that."""
    top = F.array_max(scores)
    return F.when(top == float("-inf"), top).otherwise(top + F.log(total(F.transform(scores, lambda s: F.exp(s - top)))))


def normalised(scores: Column) -> Column:
    """Log scores less their total."""
    return F.transform(scores, lambda s: s - log_total(scores))


def weight_normalised(direction: Column, length: Column) -> Column:
    """length * direction / |direction|"""
    return F.transform(direction, lambda x: x * length / norm(direction))


def argmax(scores: Column) -> Column:
    """The first position, from 0, of the greatest."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def above(p: Column, threshold: float) -> Column:
    return F.when(p >= threshold, 1.0).otherwise(0.0)


def activation(name: str, z: Column) -> Column:
    return {"identity": lambda: z, "relu": lambda: F.greatest(z, F.lit(0.0)), "sigmoid": lambda: logistic(z), "tanh": lambda: F.tanh(z)}[name]()


def activation_slope(name: str, z: Column) -> Column:
    s = logistic(z)
    return {"identity": lambda: F.lit(1.0), "relu": lambda: F.when(z > 0, 1.0).otherwise(0.0), "sigmoid": lambda: s * (1 - s), "tanh": lambda: 1 - F.tanh(z) * F.tanh(z)}[name]()


def squared_error(predicted: Column, actual: Column) -> Column:
    return (predicted - actual) * (predicted - actual) / 2


def absolute_error(predicted: Column, actual: Column) -> Column:
    return F.abs(predicted - actual)


def huber_error(predicted: Column, actual: Column, delta: float = 1.0) -> Column:
    r = F.abs(predicted - actual)
    return F.when(r <= delta, r * r / 2).otherwise(delta * (r - delta / 2))


def binary_cross_entropy(z: Column, actual: Column) -> Column:
    """On the score before the sigmoid: max(z, 0) - z y + log(1 + exp(-|z|))."""
    return F.greatest(z, F.lit(0.0)) - z * actual + F.log1p(F.exp(-F.abs(z)))


def gini(shares: Column) -> Column:
    return 1 - total(F.transform(shares, lambda p: p * p))


def entropy(shares: Column) -> Column:
    return -total(F.transform(shares, lambda p: F.when(p > 0, p * F.log2(p)).otherwise(0.0)))


def inverse_document_frequency(df: Column, n: Column) -> Column:
    return F.log((1 + n) / (1 + df)) + 1


#: 32-bit FNV-1a: offset basis and prime (fixed values).
FNV_BASIS, FNV_PRIME = 2166136261, 16777619


def utf8_bytes(text: Column) -> Column:
    """The UTF-8 bytes as an array of integers."""
    hexed = F.hex(F.encode(text, "UTF-8"))
    n = F.octet_length(text)
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(F.substring(hexed, i * 2 + 1, F.lit(2)), 16, 10).cast("int")))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes, as a long."""
    return F.aggregate(utf8_bytes(text), F.lit(FNV_BASIS).cast("long"), lambda h, b: (h.bitwiseXOR(b.cast("long")) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(0xFFFFFFFF)))


def code_points(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))


def hashed_characters(text: Column, primes: Sequence[int], buckets: int) -> Column:
    """For each character, a bucket by each prime: ((code point + 1) * prime) mod buckets."""
    return F.transform(code_points(text), lambda c: F.array(*[((c + 1).cast("long") * p) % buckets for p in primes]))
