"""Markov chains and n-gram models: windows and counts."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.errors import InvalidParameter, StateError
from corvane.sources.model_store import persistable

START, END, UNKNOWN = "<s>", "</s>", "<unk>"


def transitions(df: DataFrame, sequence: str, position: str | Sequence[str], state: str) -> DataFrame:
    """(s, t, n): how often state t follows s within a sequence."""
    order = [position] if isinstance(position, str) else list(position)
    after = F.lead(state).over(Window.partitionBy(sequence).orderBy(*order))
    return df.select(F.col(state).alias("s"), after.alias("t")).where("t is not null").groupBy("s", "t").agg(F.count("*").alias("n"))


def transition_table(counts: DataFrame, smoothing: float = 0.0) -> DataFrame:
    """(s, t, p) for all pairs of states: (n + a) / (row + a K). States are few: their table is dense."""
    states = counts.select(F.col("s").alias("x")).union(counts.select(F.col("t").alias("x"))).distinct()
    dense = states.withColumnRenamed("x", "s").join(F.broadcast(states.withColumnRenamed("x", "t")))
    row, k = F.sum("n").over(Window.partitionBy("s")), F.count("*").over(Window.partitionBy("s"))
    filled = dense.join(counts, ["s", "t"], "left").fillna(0, ["n"])
    return filled.select("s", "t", F.when(row + smoothing * k == 0, None).otherwise((F.col("n") + smoothing) / (row + smoothing * k)).alias("p"))


@persistable
@dataclass
class MarkovChain:
    states: list[str]
    table: np.ndarray

    @classmethod
    def of(cls, table: DataFrame) -> MarkovChain:
        rows = table.collect()  # states x states
        states = sorted({r["s"] for r in rows})
        at = {s: i for i, s in enumerate(states)}
        out = np.zeros((len(states), len(states)))
        for r in rows:
            if r["p"] is None:
                raise StateError(f"nothing follows {r['s']}")
            out[at[r["s"]], at[r["t"]]] = r["p"]
        return cls(states, out)

    def after(self, start: str, steps: int) -> dict[str, float]:
        if start not in self.states:
            raise StateError(start)
        p = np.linalg.matrix_power(self.table, steps)[self.states.index(start)]
        return dict(zip(self.states, map(float, p), strict=True))

    def stationary(self) -> dict[str, float]:
        """Refused where more than one closed class of states makes it ambiguous."""
        n = len(self.states)
        reach = (np.eye(n) + (self.table > 0)) > 0
        for _ in range(n.bit_length()):
            reach = (reach.astype(int) @ reach.astype(int)) > 0
        closed = {tuple(np.flatnonzero(reach[i])) for i in range(n) if all(reach[j, i] for j in np.flatnonzero(reach[i]))}
        if len(closed) != 1:
            raise StateError("the stationary distribution isn't unique")
        a = np.vstack([self.table.T - np.eye(n), np.ones(n)])
        p = np.linalg.lstsq(a, np.append(np.zeros(n), 1.0), rcond=None)[0]
        return dict(zip(self.states, map(float, np.maximum(p, 0)), strict=True))

    def sample(self, start: str, length: int, seed: int = 0) -> list[str]:
        draw, out = np.random.default_rng(seed), [start]
        while len(out) < length:
            out.append(self.states[int(draw.choice(len(self.states), p=self.table[self.states.index(out[-1])]))])
        return out


def log_probabilities(df: DataFrame, table: DataFrame, sequence: str, position: str, state: str) -> DataFrame:
    """(sequence, log_probability): the first state isn't scored; an impossible step gives minus infinity."""
    after = F.lead(state).over(Window.partitionBy(sequence).orderBy(position))
    steps = df.select(sequence, F.col(state).alias("s"), after.alias("t"))
    scored = steps.join(F.broadcast(table), ["s", "t"], "left")
    value = F.when(F.col("t").isNull(), 0.0).when(F.coalesce("p", F.lit(0.0)) == 0, float("-inf")).otherwise(F.log("p"))
    return scored.groupBy(sequence).agg(F.sum(value).alias("log_probability"))


def padded(words: Column, order: int) -> Column:
    return F.concat(F.array_repeat(F.lit(START), order - 1), words, F.array(F.lit(END)))


def grams(words: Column, n: int) -> Column:
    """Runs of n neighbours, as arrays; none where there are fewer words."""
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.slice(words, i, n))
    return F.when(F.size(words) >= n, runs).otherwise(F.array().cast("array<array<string>>"))


def character_grams(word: Column, n: int, start: str = "", end: str = "") -> Column:
    letters = F.filter(F.split(F.concat(F.lit(start), word, F.lit(end)), ""), lambda c: c != "")
    return F.transform(grams(letters, n), lambda g: F.array_join(g, ""))


def gram_counts(df: DataFrame, words: str, order: int) -> DataFrame:
    """(gram array, size, n) of orders 1 to ``order`` over padded sentences; runs that end in a start mark aren't counted.

    Only runs of the full order are counted over the words: each place ends one of them, so the shorter
    runs' counts are sums over their suffixes.
    """
    p = df.select(padded(F.col(words), order).alias("_p"))
    shifted = [F.slice("_p", k + 1, F.size("_p") - order + 1).alias(f"w{k}") for k in range(order)]
    names = [f"w{k}" for k in range(order)]
    whole = p.select(F.explode(F.arrays_zip(*shifted)).alias("g")).groupBy(*[f"g.{k}" for k in names]).agg(F.count("*").alias("n"))
    sets = [F.array(*names[order - size :]).alias("gram") for size in range(1, order + 1)]
    return whole.select(F.explode(F.array(*sets)).alias("gram"), "n").groupBy("gram").agg(F.sum("n").alias("n")).withColumn("size", F.size("gram"))


def contexts(counts: DataFrame, order: int) -> DataFrame:
    """(context, total, followers) of the runs of the given order."""
    of = counts.where(F.col("size") == order).withColumn("context", F.slice("gram", 1, order - 1))
    return of.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("followers"))


def preceding_types(counts: DataFrame, order: int) -> DataFrame:
    """(gram, types): in how many words' wake a run of order - 1 stands."""
    of = counts.where(F.col("size") == order).withColumn("rest", F.slice("gram", 2, order - 1))
    return of.groupBy(F.col("rest").alias("gram")).agg(F.count("*").alias("types"))


def frequency_of_frequencies(counts: DataFrame, order: int) -> DataFrame:
    return counts.where(F.col("size") == order).groupBy(F.col("n").alias("r")).agg(F.count("*").alias("n_r"))


def bigram_probabilities(counts: DataFrame, pretended: float = 0.0) -> DataFrame:
    """(context, word, p) by (C + k) / (C(context) + k V); 0 pretended counts are maximum likelihood."""
    two, one = counts.where("size = 2"), counts.where("size = 1")
    size = one.agg(F.count("*").alias("v"))
    seen = two.select(F.col("gram")[0].alias("context"), F.col("gram")[1].alias("word"), "n")
    totals = seen.groupBy("context").agg(F.sum("n").alias("total"))
    return seen.join(totals, "context").join(F.broadcast(size)).select("context", "word", ((F.col("n") + pretended) / (F.col("total") + pretended * F.col("v"))).alias("p"))


def conditional(counts: DataFrame, order: int, pretended: float = 0.0) -> DataFrame:
    """(context array, word, n, p) of a model of any order: (C(context word) + k) / (C(context) + k V).

    V is the number of different words and end marks; 0 pretended counts are maximum likelihood.
    """
    if order < 1 or pretended < 0:
        raise InvalidParameter(f"order {order} and {pretended} pretended counts")
    size = counts.where("size = 1").agg(F.count("*").alias("v"))
    seen = counts.where(F.col("size") == order).select(F.slice("gram", 1, order - 1).alias("context"), F.element_at("gram", -1).alias("word"), "n")
    totals = seen.groupBy("context").agg(F.sum("n").alias("total"))
    return seen.join(totals, "context").join(F.broadcast(size)).select("context", "word", "n", ((F.col("n") + pretended) / (F.col("total") + pretended * F.col("v"))).alias("p"))


def next_words(model: DataFrame, k: int = 1) -> DataFrame:
    """(context, word, p, rank): the k most probable words after each context, ties to the lesser word."""
    order = Window.partitionBy("context").orderBy(F.desc("p"), "word")
    return model.select("context", "word", "p", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)


def text_scores(df: DataFrame, key: str, words: str, model: DataFrame, order: int) -> DataFrame:
    """(key, n, log_probability): every word and the end mark given its context; an unseen run gives minus infinity."""
    runs = df.select(key, F.explode(grams(padded(F.col(words), order), order)).alias("_g"))
    steps = runs.select(key, F.slice("_g", 1, order - 1).alias("context"), F.element_at("_g", -1).alias("word"))
    scored = steps.join(model.select("context", "word", "p"), ["context", "word"], "left")
    return scored.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.log("p"), F.lit(float("-inf")))).alias("log_probability"))


def generate(model: DataFrame, order: int, longest: int = 20, start: Sequence[str] = ()) -> list[str]:
    """The most probable word after each context, from the start marks or ``start`` on, up to the end mark.

    Each step is one look-up; the text, not the model, comes to the driver.
    """
    best = next_words(model).select("context", "word")
    context, out = ([START] * (order - 1) + list(start))[-(order - 1) :] if order > 1 else [], list(start)
    while len(out) < longest:
        row = best.where(F.col("context") == F.array(*[F.lit(w) for w in context]).cast("array<string>")).first()
        if row is None or row["word"] == END:
            break
        out.append(row["word"])
        context = [*context, row["word"]][1:] if order > 1 else []
    return out


def discounted_returns(df: DataFrame, episode: str, step: str, reward: str, gamma: float) -> DataFrame:
    """With ``discounted``: the sum of gamma^(t - s) * reward over all steps t from s on.

    By doubling: after round k a step holds the sum over 2^k steps, and adds that of the step 2^k later,
    discounted by the steps between. Rates under 1 need no more rounds than until their power is zero
    in a double, whatever the episode's length; all windows share one sort.
    """
    if not 0 <= gamma <= 1:
        raise InvalidParameter(f"gamma: {gamma} is not in [0, 1]")
    if gamma in (0, 1):
        rounds = 0 if gamma == 0 else math.ceil(math.log2(max(df.groupBy(episode).count().agg(F.max("count")).first()[0] or 1, 2)))
    else:
        rounds = math.ceil(math.log2(750 / -math.log(gamma))) + 1
    of = Window.partitionBy(episode).orderBy(step)
    out = df.withColumn("discounted", F.col(reward).cast("double"))
    for k in range(rounds):
        gap = F.lead(step, 1 << k).over(of) - F.col(step)
        out = out.withColumn("discounted", F.col("discounted") + F.coalesce(F.pow(F.lit(float(gamma)), gap.cast("double")) * F.lead("discounted", 1 << k).over(of), F.lit(0.0)))
    return out
