"""Column expressions for tokenizers that need no learning: bytes, patches, hashes, quantisers, sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions.vectors import code_points, total, utf8_bytes


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def patches(text: Column, size: int) -> Column:
    """The UTF-8 bytes in blocks of ``size``; the last may be shorter."""
    data = utf8_bytes(text)
    return F.when(F.size(data) == 0, F.array().cast("array<array<int>>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(data), F.lit(size)), lambda i: F.slice(data, i, size)))


def trigram_buckets(word: Column, buckets: int, multiplier: int = 1_000_003, mark: str = "_") -> Column:
    """The sorted distinct buckets of a word's trigrams, marked at both ends, by a polynomial of code points."""
    points = code_points(F.concat(F.lit(mark), word, F.lit(mark)))
    value = lambda i: (F.get(points, i).cast("long") * multiplier + F.get(points, i + 1)) % buckets * multiplier + F.get(points, i + 2)
    return F.when(F.size(points) < 3, F.array().cast("array<long>")).otherwise(F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(points) - 3), lambda i: value(i) % buckets))))


def bucket_overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def scalar_codes(vector: Column, levels: Sequence[int]) -> Column:
    """Finite scalar quantisation: tanh, the nearest of an odd number of levels (half to even), mixed radix."""
    place, out = 1, F.lit(0).cast("long")
    for i, n in enumerate(levels):
        half = (n - 1) / 2
        out = out + (F.rint(F.tanh(F.get(vector, F.lit(i))) * half) + half).cast("long") * place
        place *= n
    return out


def nucleus(logits: DataFrame, group: str, token: str, logit: str, temperature: float = 1.0, top_p: float = 1.0) -> DataFrame:
    """(group, token, p): softmax at a temperature, cut to the least prefix that reaches top_p, the crossing token
    included, and normalised. The vocabulary of a group is the bound on its window."""
    scaled = logits.withColumn("_z", F.col(logit) / temperature)
    w = Window.partitionBy(group)
    shares = scaled.withColumn("_e", F.exp(F.col("_z") - F.max("_z").over(w))).withColumn("_p", F.col("_e") / F.sum("_e").over(w))
    before = w.orderBy(F.desc("_p"), token).rowsBetween(Window.unboundedPreceding, -1)
    kept = shares.withColumn("_b", F.coalesce(F.sum("_p").over(before), F.lit(0.0))).where(F.col("_b") < top_p)
    return kept.select(group, token, (F.col("_p") / F.sum("_p").over(w)).alias("p"))


def masked_cross_entropy(log_p: Column, mask: Column) -> Column:
    """An aggregate: the mean of -log p where the mask holds."""
    return F.avg(F.when(mask, -log_p))


def diffused(x: Column, noise: Column, kept: Column) -> Column:
    """sqrt(a) x + sqrt(1 - a) noise, a being the product of 1 - beta so far."""
    return F.sqrt(kept) * x + F.sqrt(1 - kept) * noise


def recovered(x: Column, noise: Column, kept: Column) -> Column:
    return (x - F.sqrt(1 - kept) * noise) / F.sqrt(kept)


def mean_vector(vectors: Column) -> Column:
    """Of an array of arrays of one length."""
    n = F.size(vectors)
    return F.transform(F.get(vectors, F.lit(0)), lambda _, i: total(F.transform(vectors, lambda v: F.get(v, i).cast("double"))) / n)
