"""Count-based embeddings of words and documents."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.vectors import inverse_document_frequency, norm, total
from corvane.operators.decomposition import truncated_svd


def cooccurrences(ids: DataFrame, window: int = 5, harmonic: bool = False, sequence: str = "ids") -> DataFrame:
    """(a, b, n): how often words stand within ``window`` places of each other, both ways; a pair d
    places apart counts 1, or 1 / d. Pairs come from slices of one sequence, never from a join."""
    ahead = F.transform(sequence, lambda x, i: F.transform(F.slice(sequence, i + 2, window), lambda y, d: F.struct(x.alias("a"), y.alias("b"), (1.0 / (d + 1) if harmonic else F.lit(1.0)).alias("w"))))
    one = ids.select(F.explode(F.flatten(ahead)).alias("p")).groupBy("p.a", "p.b").agg(F.sum("p.w").alias("w"))
    both = one.union(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    return both.groupBy("a", "b").agg(F.sum("w").alias("n"))


def positive_pmi(counts: DataFrame, smoothing: float = 0.75, shift: float = 0.0) -> DataFrame:
    """(a, b, ppmi) where positive: log(P(a, b) / (P(a) P(b)^smoothing / sum)) - shift."""
    whole = counts.agg(F.sum("n").alias("all"))
    rows = counts.groupBy("a").agg(F.sum("n").alias("row"))
    cols = counts.groupBy("b").agg(F.pow(F.sum("n"), F.lit(smoothing)).alias("col"))
    col_all = cols.agg(F.sum("col").alias("col_all"))
    joined = counts.join(rows, "a").join(cols, "b").join(F.broadcast(whole)).join(F.broadcast(col_all))
    value = F.log((F.col("n") / F.col("all")) / ((F.col("row") / F.col("all")) * (F.col("col") / F.col("col_all")))) - shift
    return joined.select("a", "b", value.alias("ppmi")).where("ppmi > 0")


def term_counts(df: DataFrame, key: str, words: str) -> DataFrame:
    return df.select(key, F.explode(words).alias("word")).groupBy(key, "word").agg(F.count("*").alias("n"))


def term_weights(terms: DataFrame, n_documents: DataFrame, key: str) -> DataFrame:
    """(key, word, weight): count times log((1 + N) / (1 + df)) + 1. n_documents has one row, n_docs."""
    df = terms.groupBy("word").agg(F.count("*").alias("df"))
    return terms.join(df, "word").join(F.broadcast(n_documents)).select(key, "word", (F.col("n") * inverse_document_frequency(F.col("df"), F.col("n_docs"))).alias("weight"))


def unit_length(weights: DataFrame, key: str, value: str = "weight") -> DataFrame:
    """Each document's weights over their Euclidean length."""
    length = weights.groupBy(key).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("_len"))
    return weights.join(length, key).withColumn(value, F.when(F.col("_len") == 0, 0.0).otherwise(F.col(value) / F.col("_len"))).drop("_len")


def pooled(terms: DataFrame, vectors: DataFrame, key: str, dimension: int, weight: str = "n") -> DataFrame:
    """(key, vector): the weighted mean of the words' vectors (word, vector); other words are left out."""
    joined = terms.join(vectors, "word")
    sums = joined.groupBy(key).agg(F.sum(weight).alias("_w"), *[F.sum(F.col(weight) * F.col("vector")[i]).alias(f"_s{i}") for i in range(dimension)])
    return sums.select(key, F.array(*[F.col(f"_s{i}") / F.col("_w") for i in range(dimension)]).alias("vector"))


def inverse_frequency_weights(counts: DataFrame, a: float = 1e-3) -> DataFrame:
    """(word, weight): a / (a + p(word))."""
    whole = counts.agg(F.sum("n").alias("all"))
    return counts.join(F.broadcast(whole)).select("word", (F.lit(a) / (a + F.col("n") / F.col("all"))).alias("weight"))


def without_first_component(rows: DataFrame, key: str, dimension: int, vector: str = "vector") -> DataFrame:
    """The rows less their part along the first singular direction, which comes from one pass of products."""
    v = [F.col(vector)[i] for i in range(dimension)]
    found = rows.agg(*[F.sum(v[i] * v[j]).alias(f"p{i}_{j}") for i in range(dimension) for j in range(i + 1)]).first()
    product = np.array([[found[f"p{max(i, j)}_{min(i, j)}"] for j in range(dimension)] for i in range(dimension)])
    u = np.linalg.eigh(product)[1][:, -1]
    along = sum((x * float(w) for x, w in zip(v, u, strict=True)), F.lit(0.0))
    return rows.select(key, F.array(*[x - along * float(w) for x, w in zip(v, u, strict=True)]).alias(vector))


def factorised(entries: DataFrame, n_rows: int, dimension: int, exponent: float = 0.5) -> np.ndarray:
    """U_k s_k^exponent of a bounded square table of (a, b, value): the vocabulary is the bound."""
    table = np.zeros((n_rows, n_rows))
    for r in entries.collect():  # at most vocabulary squared
        table[r[0], r[1]] = r[2]
    u, s, _ = truncated_svd(table, dimension)
    return u * s**exponent


def random_index(counts: DataFrame, dimension: int = 50, n_nonzero: int = 4, seed: int = 0) -> DataFrame:
    """(a, vector): the sum of its neighbours' index vectors, which have a few entries of 1 and -1 by hash."""
    place = lambda k: F.pmod(F.xxhash64(F.lit(seed * 1000 + k), F.col("b")), F.lit(dimension))
    parts = F.array(*[F.struct(place(k).alias("i"), F.lit(1.0 if k % 2 == 0 else -1.0).alias("s")) for k in range(n_nonzero)])
    long = counts.select("a", "n", F.explode(parts).alias("x"))
    sums = long.groupBy("a").agg(*[F.sum(F.when(F.col("x.i") == i, F.col("n") * F.col("x.s")).otherwise(0.0)).alias(f"v{i}") for i in range(dimension)])
    return sums.select("a", F.array(*[f"v{i}" for i in range(dimension)]).alias("vector"))


def sampling_weights(counts: DataFrame, exponent: float = 0.75) -> DataFrame:
    """(word, p): counts to a power, normalised."""
    powers = counts.select("word", F.pow("n", F.lit(exponent)).alias("w"))
    return powers.join(F.broadcast(powers.agg(F.sum("w").alias("all")))).select("word", (F.col("w") / F.col("all")).alias("p"))


def huffman_codes(counts: Sequence[int]) -> list[str]:
    """A prefix code for each word of a vocabulary, by its count."""
    import heapq

    heap = [(n, i, i) for i, n in enumerate(counts)]
    heapq.heapify(heap)
    children: dict[int, tuple[int, int]] = {}
    number = len(counts)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        children[number] = (a[2], b[2])
        heapq.heappush(heap, (a[0] + b[0], number, number))
        number += 1
    codes = [""] * len(counts)
    stack = [(heap[0][2], "")] if heap else []
    while stack:
        at, code = stack.pop()
        if at in children:
            stack += [(children[at][0], code + "0"), (children[at][1], code + "1")]
        else:
            codes[at] = code or "0"
    return codes


def overlap_retrieval(df: DataFrame, key: str, words: str, query: Sequence[str], limit: int = 2) -> DataFrame:
    """(key, score): documents by the cosine of word counts with the query's, if above zero."""
    q = {w: query.count(w) for w in query}
    wanted = F.create_map(*[x for w, n in q.items() for x in (F.lit(w), F.lit(float(n)))])
    terms = term_counts(df, key, words)
    scored = terms.groupBy(key).agg(F.sum(F.col("n") * F.coalesce(wanted[F.col("word")], F.lit(0.0))).alias("dot"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("len"))
    size = float(np.sqrt(sum(n * n for n in q.values())))
    return scored.select(key, (F.col("dot") / (F.col("len") * size)).alias("score")).where("score > 0").orderBy(F.desc("score"), key).limit(limit)


__all__ = ["cooccurrences", "factorised", "huffman_codes", "norm", "pooled", "positive_pmi", "term_counts", "term_weights", "total", "unit_length"]
