"""Decision trees and ensembles, grown level by level.

A level is one pass: rows are sent to their node by the tree so far (an expression), unpivoted to
(node, feature, value) and summed by distinct value before any shuffle; running sums over the
distinct values give the gain of every midpoint, and one row a node comes back to the driver.
``bins`` replaces values by that many quantile cuts where a feature has more distinct values.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.errors import EmptyInputError
from corvane.functions.vectors import total
from corvane.scratch import written
from corvane.sources.model_store import persistable


@persistable
@dataclass
class Node:
    sums: list[float]  # weights by class, or weight, w y and w y^2
    n: float
    feature: str = ""
    threshold: float = 0.0
    gain: float = 0.0
    left: int = -1
    right: int = -1


@persistable
@dataclass
class Tree:
    names: list[str]
    n_classes: int  # 0: regression
    nodes: list[Node] = field(default_factory=list)

    def walk(self, leaf, at: int = 0) -> Column:
        """``leaf(number, node)`` of the leaf that a row falls in; a value below the threshold goes left."""
        node = self.nodes[at]
        if node.left < 0:
            return leaf(at, node)
        return F.when(F.col(node.feature) < node.threshold, self.walk(leaf, node.left)).otherwise(self.walk(leaf, node.right))

    def value(self) -> Column:
        """The leaf's mean, or its commonest class (the first of equal ones)."""
        return self.walk(lambda _, x: F.lit(float(np.argmax(x.sums)) if self.n_classes else x.sums[1] / x.sums[0]))

    def probabilities(self) -> Column:
        return self.walk(lambda _, x: F.array(*[F.lit(float(s / sum(x.sums))) for s in x.sums]))

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", self.value())

    def importances(self) -> dict[str, float]:
        """Gain by feature, weighted by rows, adding up to one."""
        out = dict.fromkeys(self.names, 0.0)
        for x in self.nodes:
            if x.left >= 0:
                out[x.feature] += x.n * x.gain
        whole = sum(out.values())
        return {k: v / whole if whole else 0.0 for k, v in out.items()}

    def describe(self, at: int = 0, depth: int = 0) -> str:
        x, pad = self.nodes[at], "  " * depth
        if x.left < 0:
            return f"{pad}{x.sums}\n"
        return f"{pad}{x.feature} < {x.threshold:g} (gain {x.gain:.6f})\n" + self.describe(x.left, depth + 1) + self.describe(x.right, depth + 1)


def impurity(sums: list[Column], criterion: str) -> Column:
    if criterion == "variance":
        return F.greatest(F.lit(0.0), sums[2] / sums[0] - (sums[1] / sums[0]) * (sums[1] / sums[0]))
    n = sum(sums[1:], sums[0])
    if criterion == "gini":
        return 1 - sum(((s / n) * (s / n) for s in sums), F.lit(0.0))
    return -sum((F.when(s > 0, s / n * F.log2(s / n)).otherwise(0.0) for s in sums), F.lit(0.0))


def candidates(rows: DataFrame, features: Sequence[str], n_classes: int, criterion: str, node: str = "node", weight: str = "weight", target: str = "target", bins: int | None = None) -> DataFrame:
    """(node, feature, threshold, gain, left_n, n, l*, s*): the gain of every midpoint of every feature."""
    if n_classes:
        values = [F.when(F.col(target) == k, F.col(weight)).otherwise(0.0) for k in range(n_classes)]
    else:
        values = [F.col(weight), F.col(weight) * F.col(target), F.col(weight) * F.col(target) * F.col(target)]
    m = len(values)
    cut = rows
    if bins:
        marks = rows.agg(*[F.percentile_approx(c, [i / bins for i in range(1, bins)], 10_000).alias(c) for c in features]).first()
        for c in features:
            edges = sorted(set(marks[c]))
            cut = cut.withColumn(c, sum((F.when(F.col(c) >= e, e - p).otherwise(0.0) for p, e in zip([0.0, *edges], edges, strict=False)), F.lit(0.0))) if edges else cut
    long = cut.select(node, F.lit(1.0).alias("rows"), *[v.alias(f"v{i}") for i, v in enumerate(values)], F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), F.col(c).cast("double").alias("value")) for i, c in enumerate(features)])).alias("f"))
    distinct = long.groupBy(node, "f.feature", "f.value").agg(F.sum("rows").alias("rows"), *[F.sum(f"v{i}").alias(f"v{i}") for i in range(m)])
    run = Window.partitionBy(node, "feature").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(node, "feature")
    after = Window.partitionBy(node, "feature").orderBy("value")
    sums = distinct.select(node, "feature", ((F.col("value") + F.lead("value").over(after)) / 2).alias("threshold"), F.sum("rows").over(run).alias("left_n"), F.sum("rows").over(whole).alias("n"), *[F.sum(f"v{i}").over(run).alias(f"l{i}") for i in range(m)], *[F.sum(f"v{i}").over(whole).alias(f"s{i}") for i in range(m)]).where(F.col("threshold").isNotNull())
    left, all_ = [F.col(f"l{i}") for i in range(m)], [F.col(f"s{i}") for i in range(m)]
    right = [a - b for a, b in zip(all_, left, strict=True)]
    weigh = (lambda s: s[0]) if not n_classes else (lambda s: sum(s[1:], s[0]))
    share = weigh(left) / weigh(all_)
    gain = impurity(all_, criterion) - share * impurity(left, criterion) - (1 - share) * impurity(right, criterion)
    return sums.where((weigh(left) > 0) & (weigh(right) > 0)).withColumn("gain", gain)


def best_splits(found: DataFrame, features: Sequence[str], min_leaf: int = 1, min_decrease: float = 0.0, node: str = "node", allowed: dict[int, list[int]] | None = None) -> DataFrame:
    """One row a node: the greatest gain; ties go to the earlier feature, then the lower threshold."""
    fits = found.where((F.col("left_n") >= min_leaf) & (F.col("n") - F.col("left_n") >= min_leaf) & (F.round("gain", 12) > min_decrease))
    if allowed:
        ok = F.lit(False)
        for k, v in allowed.items():
            ok = ok | ((F.col(node) == k) & F.col("feature").isin(v))
        fits = fits.where(ok)
    order = F.struct((-F.round("gain", 12)).alias("o"), "feature", "threshold", *[c for c in found.columns if c not in (node, "feature", "threshold")])
    names = F.array(*[F.lit(c) for c in features])
    return fits.groupBy(node).agg(F.min(order).alias("b")).select(node, F.element_at(names, F.col("b.feature") + 1).alias("feature"), "b.threshold", "b.gain", *[f"b.{c}" for c in found.columns if c not in (node, "feature", "threshold", "gain")])


def grow(df: DataFrame, features: Sequence[str], target: str, n_classes: int = 0, criterion: str | None = None, max_depth: int | None = None, min_split: int = 2, min_leaf: int = 1, min_decrease: float = 0.0, max_features: int | None = None, weight: Column | None = None, bins: int | None = None, seed: int = 0) -> Tree:
    """A tree; a node that no split improves, or with fewer than ``min_split`` rows, is a leaf."""
    criterion = criterion or ("gini" if n_classes else "variance")
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in features], F.col(target).cast("double").alias("target"), (F.lit(1.0) if weight is None else weight).alias("weight")).where("weight > 0")
    m = n_classes or 3
    values = [F.sum(F.when(F.col("target") == k, F.col("weight")).otherwise(0.0)) for k in range(n_classes)] if n_classes else [F.sum("weight"), F.sum(F.col("weight") * F.col("target")), F.sum(F.col("weight") * F.col("target") * F.col("target"))]
    root = rows.agg(F.count("*"), *values).first()
    if not root[0]:
        raise EmptyInputError("no rows to grow a tree from")
    tree = Tree(list(features), n_classes, [Node([float(v) for v in root[1:]], float(root[0]))])
    draw, open_nodes, depth = random.Random(seed), [0], 0
    while open_nodes and (max_depth is None or depth < max_depth):
        place = tree.walk(lambda i, _: F.lit(i))
        here = [i for i in open_nodes if tree.nodes[i].n >= min_split]
        if not here:
            break
        level = rows.withColumn("node", place).where(F.col("node").isin(here))
        allowed = {i: draw.sample(range(len(features)), min(max_features, len(features))) for i in here} if max_features else None
        found = best_splits(candidates(level, features, n_classes, criterion, bins=bins), features, min_leaf, min_decrease, allowed=allowed).orderBy("node").collect()
        open_nodes = []
        for r in found:  # at most one row for each open node
            x = tree.nodes[r["node"]]
            left = [float(r[f"l{i}"]) for i in range(m)]
            right = [float(r[f"s{i}"] - r[f"l{i}"]) for i in range(m)]
            x.feature, x.threshold, x.gain, x.left, x.right = r["feature"], float(r["threshold"]), float(r["gain"]), len(tree.nodes), len(tree.nodes) + 1
            tree.nodes += [Node(left, float(r["left_n"])), Node(right, float(r["n"] - r["left_n"]))]
            open_nodes += [x.left, x.right]
        depth += 1
    return tree


def bootstrap_weight(key: str, member: int, seed: int = 0) -> Column:
    """How often a row is drawn: Poisson with the mean 1, from a hash of its key and the member."""
    u = F.pmod(F.xxhash64(F.lit(seed * 7919 + member), F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    edges, p, acc = [], np.exp(-1.0), 0.0
    for k in range(8):
        acc += p
        edges.append(acc)
        p /= k + 1
    return sum((F.when(u >= float(e), 1.0).otherwise(0.0) for e in edges), F.lit(0.0))


@persistable
@dataclass
class Ensemble:
    """The mean of the members' values or class shares, or their sum from ``start`` by ``rates``."""

    trees: list[Tree]
    start: float = 0.0
    rates: list[float] = field(default_factory=list)
    kind: str = "mean"  # mean, boost or vote

    def predict(self, df: DataFrame) -> DataFrame:
        if self.kind == "boost":
            value = sum((F.lit(r) * t.value() for r, t in zip(self.rates, self.trees, strict=True)), F.lit(self.start))
            return df.withColumn("prediction", value)
        k = self.trees[0].n_classes
        if self.kind == "vote":
            shares = [sum((F.when(t.value() == c, r).otherwise(0.0) for r, t in zip(self.rates, self.trees, strict=True)), F.lit(0.0)) / sum(self.rates) for c in range(k)]
        elif k:
            shares = [sum((t.probabilities()[c] for t in self.trees), F.lit(0.0)) / len(self.trees) for c in range(k)]
        else:
            return df.withColumn("prediction", sum((t.value() for t in self.trees), F.lit(0.0)) / len(self.trees))
        out = df.withColumn("probabilities", F.array(*shares))
        return out.withColumn("prediction", F.array_position("probabilities", F.array_max("probabilities")).cast("double") - 1)

    def importances(self) -> dict[str, float]:
        found = [t.importances() for t in self.trees]
        return {c: sum(f[c] for f in found) / len(found) for c in self.trees[0].names}


def forest(df: DataFrame, key: str, features: Sequence[str], target: str, n_members: int = 10, seed: int = 0, **options) -> Ensemble:
    """Bagging; with ``max_features`` a random forest."""
    return Ensemble([grow(df, features, target, weight=bootstrap_weight(key, i, seed), seed=seed + i, **options) for i in range(n_members)])


def out_of_bag(model: Ensemble, df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """(key, prediction): each row by the members that didn't draw it; null where all did."""
    missed = [bootstrap_weight(key, i, seed) == 0 for i in range(len(model.trees))]
    n = sum((F.when(x, 1.0).otherwise(0.0) for x in missed), F.lit(0.0))
    k = model.trees[0].n_classes
    if k:
        sums = F.array(*[sum((F.when(x, t.probabilities()[c]).otherwise(0.0) for x, t in zip(missed, model.trees, strict=True)), F.lit(0.0)) for c in range(k)])
        value = F.array_position(sums, F.array_max(sums)).cast("double") - 1
    else:
        value = sum((F.when(x, t.value()).otherwise(0.0) for x, t in zip(missed, model.trees, strict=True)), F.lit(0.0)) / n
    return df.select(key, F.when(n > 0, value).alias("prediction"))


def boosting(df: DataFrame, features: Sequence[str], target: str, n_rounds: int = 20, rate: float = 0.1, max_depth: int = 3, **options) -> Ensemble:
    """From the mean, each tree on the residuals; the residuals are written every fifth round."""
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in features], F.col(target).cast("double").alias("_y"))
    start = float(rows.agg(F.avg("_y")).first()[0])
    rows, trees = rows.withColumn("_y", F.col("_y") - start), []
    for i in range(n_rounds):
        trees.append(grow(rows, features, "_y", max_depth=max_depth, **options))
        rows = rows.withColumn("_y", F.col("_y") - rate * trees[-1].value())
        if i % 5 == 4:
            rows = written(rows, "boosting")
    return Ensemble(trees, start, [rate] * n_rounds, "boost")


def adaboost(df: DataFrame, features: Sequence[str], target: str, n_classes: int, n_members: int = 10, rate: float = 1.0, max_depth: int = 1) -> Ensemble:
    """SAMME: a member's voice is rate * (log((1 - e) / e) + log(K - 1)); rows it errs on gain weight."""
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in features], F.col(target).cast("double").alias("_y"), F.lit(1.0).alias("_w"))
    trees, voices = [], []
    for _ in range(n_members):
        tree = grow(rows, features, "_y", n_classes=n_classes, max_depth=max_depth, weight=F.col("_w"))
        wrong = tree.value() != F.col("_y")
        error = float(rows.agg(F.sum(F.when(wrong, F.col("_w")).otherwise(0.0)) / F.sum("_w")).first()[0])
        if error <= 0:
            return Ensemble([*trees, tree], 0.0, [*voices, 1.0], "vote")
        voice = rate * (np.log((1 - error) / error) + np.log(n_classes - 1))
        if voice <= 0:
            break
        trees.append(tree)
        voices.append(float(voice))
        rows = written(rows.withColumn("_w", F.when(wrong, F.col("_w") * float(np.exp(voice))).otherwise(F.col("_w"))), "adaboost")
    return Ensemble(trees or [tree], 0.0, voices or [1.0], "vote")


def permutation_importance(df: DataFrame, key: str, features: Sequence[str], score, seed: int = 0) -> dict[str, float]:
    """How much ``score(df)`` falls when a feature's values are dealt anew, clipped at 0, adding up to 1.

    Values move along a cycle within 256 hash buckets, so nothing is sorted as a whole.
    """
    base, out = score(df), {}
    for c in features:
        ring = Window.partitionBy(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(256))).orderBy(F.xxhash64(F.lit(seed + 1), key), key)
        first = F.first(c).over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        dealt = df.withColumn("_new", F.coalesce(F.lead(c).over(ring), first)).drop(c).withColumnRenamed("_new", c)
        out[c] = max(base - score(dealt), 0.0)
    whole = sum(out.values())
    return {c: v / whole if whole else 0.0 for c, v in out.items()}


__all__ = ["Ensemble", "Tree", "adaboost", "best_splits", "boosting", "candidates", "forest", "grow", "impurity", "out_of_bag", "permutation_importance", "total"]
