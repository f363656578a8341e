"""Learned word vectors, by partition-parallel training with averaging.

Each round every task trains a copy on its own sentences (as id sequences) and returns the rows that it
changed; Spark averages each row over the tasks that did (weighted by their tokens), and the next
round starts from the averages. The tables of a bounded vocabulary are what moves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.errors import InvalidParameter


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def skip_gram(ids: DataFrame, counts: np.ndarray, dimension: int = 50, window: int = 5, negatives: int = 5, rate: float = 0.05, rounds: int = 3, exponent: float = 0.75, seed: int = 0, sequence: str = "ids") -> np.ndarray:
    """Skip-grams with negative samples drawn by counts to a power; returns (vocabulary, dimension)."""
    n = len(counts)
    draw = np.random.default_rng(seed)
    tables = np.stack([(draw.random((n, dimension)) - 0.5) / dimension, np.zeros((n, dimension))])
    chance = counts**exponent / (counts**exponent).sum()
    for r in range(rounds):
        shared = ids.sparkSession.sparkContext.broadcast((tables, chance))
        step = rate * (1 - r / rounds)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, step=step, r=r) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            (start, chance), part = shared.value, TaskContext.get().partitionId()
            own, draw = start.copy(), np.random.default_rng((seed, r, part))
            words, contexts = own
            touched, tokens = np.zeros((2, len(chance)), bool), 0
            for batch in batches:
                for s in batch.column("ids").to_pylist():
                    tokens += len(s)
                    for i, w in enumerate(s):
                        around = [s[j] for j in range(max(0, i - window), min(len(s), i + window + 1)) if j != i]
                        if not around:
                            continue
                        c = np.concatenate([around, draw.choice(len(chance), negatives * len(around), p=chance)])
                        y = np.arange(len(c)) < len(around)
                        g = step * (y - _sigmoid(contexts[c] @ words[w]))
                        moved = g @ contexts[c]
                        np.add.at(contexts, c, g[:, None] * words[w])
                        words[w] += moved
                        touched[0, w] = True
                        touched[1, c] = True
            kind, row = np.nonzero(touched)
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(row, pa.int64()), pa.array(np.full(len(row), float(tokens))), pa.array(list(own[kind, row]), pa.list_(pa.float64()))], ["kind", "row", "weight", "vector"])

        moved = ids.select(F.col(sequence).alias("ids")).mapInArrow(run, "kind int, row long, weight double, vector array<double>")
        sums = moved.groupBy("kind", "row").agg(F.sum("weight").alias("w"), *[F.sum(F.col("weight") * F.col("vector")[i]).alias(f"v{i}") for i in range(dimension)])
        for x in sums.select("kind", "row", F.array(*[F.col(f"v{i}") / F.col("w") for i in range(dimension)]).alias("v")).collect():  # at most two rows a word
            tables[x["kind"], x["row"]] = x["v"]
    return tables[0]


def glove(entries: DataFrame, n: int, dimension: int = 50, epochs: int = 25, rate: float = 0.05, most: float = 100.0, exponent: float = 0.75, seed: int = 0) -> np.ndarray:
    """Least weighted squares of log counts (a, b, n) by AdaGrad; entries of a bounded vocabulary are trained on the driver."""
    rows = entries.collect()
    a, b, x = (np.array([r[i] for r in rows]) for i in range(3))
    draw = np.random.default_rng(seed)
    w = (draw.random((2, n, dimension + 1)) - 0.5) / dimension
    g2 = np.ones_like(w)
    weight, target = np.minimum(1, (x / most) ** exponent), np.log(x)
    for _ in range(epochs):
        for i in np.array_split(draw.permutation(len(x)), max(1, len(x) // 1024)):
            left, right = w[0, a[i]], w[1, b[i]]
            e = weight[i] * ((left[:, :-1] * right[:, :-1]).sum(1) + left[:, -1] + right[:, -1] - target[i])
            for side, rows_at, other in ((0, a[i], right), (1, b[i], left)):
                grad = np.concatenate([e[:, None] * other[:, :-1], e[:, None]], 1)
                np.add.at(g2[side], rows_at, grad**2)
                np.add.at(w[side], rows_at, -rate * grad / np.sqrt(g2[side][rows_at]))
    return w[0, :, :-1] + w[1, :, :-1]


def gram_rows(word: str, least: int = 3, longest: int = 6, buckets: int = 2000) -> list[int]:
    """Buckets of a marked word's character n-grams by FNV-1a, for vectors of unseen words."""
    marked, out = f"<{word}>", []
    for n in range(least, longest + 1):
        for i in range(len(marked) - n + 1):
            h = 2166136261
            for byte in marked[i : i + n].encode():
                h = ((h ^ byte) * 16777619) & 0xFFFFFFFF
            out.append(h % buckets)
    return out


# --- gradients of one prediction ---------------------------------------------------------------------


def negative_sampling_gradients(hidden: np.ndarray, outputs: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(of the hidden vector, of each output row, loss): a logistic loss for the true word (label 1) and the noise (0)."""
    p = _sigmoid(outputs @ hidden)
    e = p - labels
    loss = -float(np.log(np.where(labels > 0, p, 1 - p)).sum())
    return e @ outputs, e[:, None] * hidden, loss


def hierarchical_softmax_gradients(hidden: np.ndarray, nodes: np.ndarray, code: str) -> tuple[np.ndarray, np.ndarray, float]:
    """The same for the inner nodes on a word's path in the code tree; a 0 in the code is the branch of p."""
    return negative_sampling_gradients(hidden, nodes, np.array([c == "0" for c in code], float))


def averaged_hidden(document: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    return (document + contexts.sum(axis=0)) / (1 + len(contexts))


def shared_input_step(gradient: np.ndarray, rate: float, n_averaged: int) -> np.ndarray:
    """What each of the averaged vectors moves by."""
    return -rate * gradient / n_averaged


def distributed_memory_gradients(document: np.ndarray, contexts: np.ndarray, outputs: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(of the average of document and context vectors, of each output row, loss)"""
    return negative_sampling_gradients(averaged_hidden(document, contexts), outputs, labels)


def distributed_bag_of_words_gradients(document: np.ndarray, outputs: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(of the document vector, of each output row, loss)"""
    return negative_sampling_gradients(document, outputs, labels)


def _fresh(name: int, dimension: int, seed: int) -> np.ndarray:
    """The vector that a document starts with: the same in every round and on every executor."""
    return (np.random.default_rng((seed, name & 0xFFFFFFFF)).random(dimension) - 0.5) / dimension


def contextual(ids: DataFrame, key: str, counts: np.ndarray, architecture: str = "cbow", dimension: int = 50, window: int = 5, negatives: int = 5, rate: float = 0.05, rounds: int = 3, epochs: int = 1, exponent: float = 0.75, seed: int = 0, sequence: str = "ids") -> tuple[np.ndarray, DataFrame]:
    """(word vectors, rows (key, vector) of the documents) by one of the architectures

    * cbow: a word is predicted from the mean of the words around it (documents have no vectors: null),
    * distributed_memory: from the mean of the document's vector and the words around it,
    * distributed_bag_of_words: from the document's vector alone.

    As in ``skip_gram``, tasks train copies of the word tables, which are averaged after each round. A
    document's vector stays with its row: it isn't shared, so it never reaches the driver; it is fitted
    to the averaged tables of the end, in ``rounds`` passes over its words.
    """
    if architecture not in ("cbow", "distributed_memory", "distributed_bag_of_words"):
        raise InvalidParameter(f"architecture: {architecture}")
    n, draw = len(counts), np.random.default_rng(seed)
    tables = np.stack([(draw.random((n, dimension)) - 0.5) / dimension, np.zeros((n, dimension))])
    chance = counts**exponent / (counts**exponent).sum()
    kind = ids.schema[key].dataType.simpleString()
    source = ids.select(F.col(key).alias("key"), F.xxhash64(F.col(key)).alias("name"), F.col(sequence).alias("ids"))
    uses_document, uses_words = architecture != "cbow", architecture != "distributed_bag_of_words"

    def trained(s, document, words, outputs, step, draw, learn, touched) -> None:
        for i, w in enumerate(s):
            around = [s[j] for j in range(max(0, i - window), min(len(s), i + window + 1)) if j != i] if uses_words else []
            if not around and not uses_document:
                continue
            contexts = words[around]
            hidden = averaged_hidden(document, contexts) if uses_document else contexts.mean(axis=0)
            c = np.concatenate([[w], draw.choice(n, negatives, p=chance)]).astype(int)
            inner, outer, _ = negative_sampling_gradients(hidden, outputs[c], np.arange(len(c)) == 0)
            moved = shared_input_step(inner, step, len(around) + uses_document)
            if uses_document:
                document += moved
            if learn:
                np.add.at(outputs, c, -step * outer)
                np.add.at(words, around, moved)
                touched[0, around] = True
                touched[1, c] = True

    for r in range(rounds):
        shared = ids.sparkSession.sparkContext.broadcast(tables)
        step = rate * (1 - r / rounds)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, step=step, r=r) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            own, draw = shared.value.copy(), np.random.default_rng((seed, r, TaskContext.get().partitionId()))
            touched, tokens = np.zeros((2, n), bool), 0
            for batch in batches:
                for name, s in zip(batch.column("name").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                    tokens += len(s)
                    document = _fresh(name, dimension, seed)
                    for _ in range(epochs):
                        trained(s, document, own[0], own[1], step, draw, True, touched)
            at, row = np.nonzero(touched)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(row, pa.int64()), pa.array(np.full(len(row), float(tokens))), pa.array(list(own[at, row]), pa.list_(pa.float64()))], ["kind", "row", "weight", "vector"])

        moved = source.select("name", "ids").mapInArrow(run, "kind int, row long, weight double, vector array<double>")
        sums = moved.groupBy("kind", "row").agg(F.sum("weight").alias("w"), *[F.sum(F.col("weight") * F.col("vector")[i]).alias(f"v{i}") for i in range(dimension)])
        for x in sums.select("kind", "row", F.array(*[F.col(f"v{i}") / F.col("w") for i in range(dimension)]).alias("v")).collect():  # at most two rows a word
            tables[x["kind"], x["row"]] = x["v"]
    if not uses_document:
        return tables[0], source.select(F.col("key").alias(key), F.lit(None).cast("array<double>").alias("vector"))
    last = ids.sparkSession.sparkContext.broadcast(tables)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, outputs = last.value
        for batch in batches:
            out = []
            for name, s in zip(batch.column("name").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                document, draw = _fresh(name, dimension, seed), np.random.default_rng((seed, name & 0xFFFFFFFF, 1))
                for r in range(rounds * epochs):
                    trained(s, document, words, outputs, rate * (1 - r / (rounds * epochs)), draw, False, None)
                out.append(document)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, pa.list_(pa.float64()))], ["key", "vector"])

    return tables[0], source.mapInArrow(fitted, f"key {kind}, vector array<double>").withColumnRenamed("key", key)


def gram_vectors(vocabulary: list[str], vectors: np.ndarray, buckets: int = 2000, penalty: float = 0.1, rounds: int = 30) -> np.ndarray:
    """A vector for each bucket of character n-grams (``gram_rows``), so that the mean over a word's buckets
    comes near its vector: unseen words then get the mean of theirs."""
    rows = [np.array(gram_rows(w, buckets=buckets)) for w in vocabulary]
    out = np.zeros((buckets, vectors.shape[1]))
    for _ in range(rounds):
        for r, v in zip(rows, vectors, strict=True):
            out[r] += (1 - penalty) * (v - out[r].mean(axis=0))
    return out


def unseen_vector(word: str, grams: np.ndarray) -> np.ndarray:
    if not word:
        raise InvalidParameter("an empty word has no n-grams")
    return grams[gram_rows(word, buckets=len(grams))].mean(axis=0)
