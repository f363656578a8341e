"""Row orders, hold-outs, folds and searches.

A row's place in a shuffled order comes from the MD5 of its key and the seed. Places are counted in
buckets of that hash, so no task sees more than its bucket, and one small table of bucket sizes is
summed: a global row number without a global sort.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a bucket of ``ranked``.
BUCKET = 100_000


def shuffle_key(key: str, seed: int = 0) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary"))


def ranked(df: DataFrame, key: str, seed: int = 0, strata: str | None = None) -> DataFrame:
    """With ``place`` (from 0) and ``n``: in shuffled order, or within strata in the order of strata.

    Buckets are the hash's first digits: as many as keep a bucket near ``BUCKET`` rows.
    """
    digits = max(2, math.ceil(math.log(max(df.count(), 1) / BUCKET + 1, 16)))
    order = [F.col(c) for c in ([strata] if strata else [])]
    marked = df.withColumn("_hash", shuffle_key(key, seed)).withColumn("_bucket", F.substring("_hash", 1, digits))
    sizes = marked.groupBy(*([strata] if strata else []), "_bucket").agg(F.count("*").alias("_size"))
    before = Window.orderBy(*order, "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).withColumn("n", F.sum("_size").over(everything)).drop("_size")
    within = Window.partitionBy(*order, "_bucket").orderBy("_hash", key)
    joined = marked.withColumn("_within", F.row_number().over(within) - 1)
    out = joined.join(F.broadcast(offsets), [*([strata] if strata else []), "_bucket"])
    return out.withColumn("place", (F.col("_before") + F.col("_within")).cast("long")).drop("_hash", "_bucket", "_before", "_within")


def hold_out(df: DataFrame, key: str, test_fraction: float = 0.25, seed: int = 0) -> DataFrame:
    """With ``is_test``: the last round(fraction * n) rows of the shuffled order, at least one on each side."""
    k = F.greatest(F.lit(1), F.least(F.col("n") - 1, F.rint(F.col("n") * test_fraction)))
    return ranked(df, key, seed).withColumn("is_test", F.col("place") >= F.col("n") - k).drop("place", "n")


def k_fold(df: DataFrame, key: str, n_folds: int = 5, seed: int = 0, strata: str | None = None) -> DataFrame:
    """With ``fold``: blocks of the shuffled order whose first ones are one row longer; with strata,
    rows are dealt round in the order of strata."""
    rows = ranked(df, key, seed, strata)
    if strata:
        return rows.withColumn("fold", (F.col("place") % n_folds).cast("int")).drop("place", "n")
    size, extra = F.floor(F.col("n") / n_folds), F.col("n") % n_folds
    late = extra + F.floor((F.col("place") - extra * (size + 1)) / F.greatest(size, F.lit(1)))
    return rows.withColumn("fold", F.when(F.col("place") < extra * (size + 1), F.floor(F.col("place") / (size + 1))).otherwise(late).cast("int")).drop("place", "n")


def classes_missing(folds: DataFrame, label: str) -> DataFrame:
    """(fold, missing): the folds that lack a class."""
    all_classes = folds.agg(F.count_distinct(label).alias("k"))
    return folds.groupBy("fold").agg(F.count_distinct(label).alias("has")).join(F.broadcast(all_classes)).where("has < k").select("fold", (F.col("k") - F.col("has")).alias("missing"))


def candidates(**ranges: Sequence[Any]) -> list[dict[str, Any]]:
    """The product of the ranges, in order."""
    return [dict(zip(ranges, values, strict=True)) for values in itertools.product(*ranges.values())]


def _sides(folds: DataFrame, n_folds: int, of: Callable[[DataFrame], Any] = lambda df: df) -> list[tuple[Any, Any]]:
    """(the other folds, the fold), as ``of`` has them, for each fold."""
    return [(of(folds.where(F.col("fold") != i)), of(folds.where(F.col("fold") == i))) for i in range(n_folds)]


def cross_validate(folds: DataFrame, n_folds: int, fit: Callable[[DataFrame], Any], score: Callable[[Any, DataFrame], float]) -> list[float]:
    """The score of each fold by a model fitted on the others; ``folds`` should be written or cached."""
    return [score(fit(train), test) for train, test in _sides(folds, n_folds)]


def grid_search(folds: DataFrame, n_folds: int, space: list[dict[str, Any]], fit: Callable[..., Any], score: Callable[[Any, Any], float], of: Callable[[DataFrame], Any] = lambda df: df) -> list[tuple[float, dict[str, Any]]]:
    """(mean score, candidate), best first; equal ones stay in the order of the space.

    ``of`` makes of rows what ``fit`` and ``score`` get, such as sums, once for all candidates: then it isn't
    the rounding of one sum against another's that tells near candidates apart.
    """
    sides = _sides(folds, n_folds, of)
    found = [(sum(score(fit(train, **c), test) for train, test in sides) / n_folds, c) for c in space]
    return sorted(found, key=lambda x: -x[0])


def spread(scores: Sequence[float]) -> tuple[float, float]:
    """Mean and population deviation of the folds' scores."""
    mean = sum(scores) / len(scores)
    return mean, (sum((x - mean) ** 2 for x in scores) / len(scores)) ** 0.5


def held_out_predictions(folds: DataFrame, n_folds: int, fit: Callable[[DataFrame], Any]) -> DataFrame:
    """Every row with the ``prediction`` of the model that was fitted on the other folds."""
    parts = [fit(folds.where(F.col("fold") != i)).predict(folds.where(F.col("fold") == i)) for i in range(n_folds)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def fold_accuracies(predicted: DataFrame, label: str) -> DataFrame:
    """(fold, n, accuracy)"""
    return predicted.groupBy("fold").agg(F.count("*").alias("n"), F.avg((F.col(label) == F.col("prediction")).cast("double")).alias("accuracy"))


def accuracy_spread(predicted: DataFrame, label: str) -> DataFrame:
    """One row: the mean of the folds' accuracies, their population deviation, and the pooled accuracy."""
    each = fold_accuracies(predicted, label)
    return each.agg(F.avg("accuracy").alias("mean_accuracy"), F.stddev_pop("accuracy").alias("accuracy_spread"), (F.sum(F.col("accuracy") * F.col("n")) / F.sum("n")).alias("pooled_accuracy"))


def honest_search(train: DataFrame, test: DataFrame, n_folds: int, space: list[dict[str, Any]], fit: Callable[..., Any], score: Callable[[Any, DataFrame], float]) -> tuple[dict[str, Any], float, float, float]:
    """(best candidate, mean and deviation of its folds' scores, its score on rows that the search hasn't seen)."""
    _, best = grid_search(train, n_folds, space, fit, score)[0]
    mean, deviation = spread(cross_validate(train, n_folds, lambda df: fit(df, **best), score))
    return best, mean, deviation, score(fit(train, **best), test)


def bootstrap(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """With ``times``: how often each row is in a sample of n draws with replacement; the rest have 0.

    Draw i takes the row at the place that the MD5 of i and the seed gives, modulo n.
    """
    rows = ranked(df, key, seed)
    n = df.count()
    spark = df.sparkSession
    drawn = spark.range(n).select((F.conv(F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit(f":draw:{seed}")).cast("binary")), 1, 12), 16, 10).cast("long") % n).alias("place"))
    times = drawn.groupBy("place").agg(F.count("*").alias("times"))
    return rows.drop("n").join(times, "place", "left").withColumn("times", F.coalesce("times", F.lit(0).cast("long"))).drop("place")
