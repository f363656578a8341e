"""Clusterings: k-means, DBSCAN, Gaussian mixtures, agglomeration and self-organising maps."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

from corvane.errors import EmptyInputError
from corvane.functions.vectors import total
from corvane.scratch import written
from corvane.sources.model_store import persistable


def _distance2(features: Sequence[str], centre: Sequence[float]) -> Column:
    return sum(((F.col(c) - float(v)) * (F.col(c) - float(v)) for c, v in zip(features, centre, strict=True)), F.lit(0.0))


def _nearest(features: Sequence[str], centres: np.ndarray) -> Column:
    """struct(d, k) of the nearest centre, the first of equal ones."""
    return F.array_min(F.array(*[F.struct(_distance2(features, c).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(centres)]))


@persistable
@dataclass
class KMeans:
    names: list[str]
    centres: np.ndarray
    inertia: float
    rounds: int = 0

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn("cluster", _nearest(self.names, self.centres)["k"])

    def summary(self, df: DataFrame) -> DataFrame:
        """(cluster, size, inertia)"""
        near = df.withColumn("_near", _nearest(self.names, self.centres))
        return near.groupBy(F.col("_near.k").alias("cluster")).agg(F.count("*").alias("size"), F.sum("_near.d").alias("inertia"))


def lloyd(df: DataFrame, features: Sequence[str], centres: np.ndarray, rounds: int = 300, tolerance: float = 1e-8) -> KMeans:
    """Each round one aggregation; an empty group keeps its centre."""
    centres = np.array(centres, float)
    for i in range(1, rounds + 1):
        near = df.withColumn("_near", _nearest(features, centres))
        found = near.groupBy("_near.k").agg(*[F.avg(c).alias(f"a{j}") for j, c in enumerate(features)], F.sum("_near.d").alias("d")).collect()
        if not found:
            raise EmptyInputError("no rows to cluster")
        after = centres.copy()
        for r in found:
            after[r["k"]] = [r[f"a{j}"] for j in range(len(features))]
        moved, centres = float(np.abs(after - centres).max()), after
        if moved < tolerance:
            break
    inertia = float(df.agg(F.sum(_nearest(features, centres)["d"])).first()[0])
    return KMeans(list(features), centres, inertia, i)


def _seeded(df: DataFrame, features: Sequence[str], k: int, key: str, seed: int) -> np.ndarray:
    """k-means++: a row is drawn with a chance in proportion to its squared distance from the chosen
    ones, as the least of exponential draws from its key's hash, so that no order matters."""
    chosen: list[list[float]] = []
    for i in range(k):
        v = F.greatest(F.pmod(F.xxhash64(F.lit(seed * 31 + i), F.col(key)), F.lit(1 << 40)) / float(1 << 40), F.lit(1e-12))
        weight = F.lit(1.0) if not chosen else _nearest(features, np.array(chosen))["d"]
        row = df.select(F.try_divide(-F.log(v), weight).alias("e"), key, *features).where(F.col("e").isNotNull()).orderBy("e", key).limit(1).first()
        chosen.append([float(row[c]) for c in features])
    return np.array(chosen)


def k_means(df: DataFrame, features: Sequence[str], key: str, k: int = 8, starts: int = 3, seed: int = 0, **options) -> KMeans:
    """The start with the least inertia."""
    return min((lloyd(df, features, _seeded(df, features, k, key, seed + i), **options) for i in range(starts)), key=lambda m: m.inertia)


def dbscan(df: DataFrame, features: Sequence[str], key: str, radius: float, least: int = 5) -> DataFrame:
    """(key, label): -1 for noise; labels are numbered by their first core key.

    Rows meet only rows of neighbouring cells of a grid of that radius: an equi-join on cells.
    """
    x = [F.col(c).cast("double") for c in features]
    rows = written(df.select(F.col(key).alias("id"), F.array(*x).alias("v"), F.array(*[F.floor(c / radius).cast("long") for c in x]).alias("cell")), "dbscan_rows")
    shifts = np.array(np.meshgrid(*[[-1, 0, 1]] * len(features), indexing="ij")).reshape(len(features), -1).T.tolist()
    around = rows.withColumn("shift", F.explode(F.array(*[F.array(*[F.lit(int(s)) for s in row]) for row in shifts]))).select("id", "v", F.zip_with("cell", "shift", lambda a, b: a + b).alias("cell"))
    gap = total(F.zip_with(F.col("a.v"), F.col("b.v"), lambda p, q: (p - q) * (p - q)))
    pairs = written(around.alias("a").join(rows.alias("b"), F.col("a.cell") == F.col("b.cell")).where(gap <= radius * radius).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), gap.alias("d")), "dbscan_pairs")
    core = written(pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= least).select(F.col("a").alias("id")), "dbscan_core")
    links = pairs.join(core.withColumnRenamed("id", "a"), "a").join(core.withColumnRenamed("id", "b"), "b")
    labels = written(core.withColumn("label", F.col("id")), "dbscan_labels")
    edges = written(links.select("a", "b"), "dbscan_links")
    while True:
        seen = edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("label"))
        # the label's own label: pointers are jumped, so chains shorten by half each round
        jump = seen.alias("s").join(labels.alias("l"), F.col("s.label") == F.col("l.id")).select(F.col("s.id").alias("id"), F.least(F.col("s.label"), F.col("l.label")).alias("label"))
        after = written(jump, "dbscan_labels")
        changed = after.alias("n").join(labels.alias("o"), "id").where(F.col("n.label") != F.col("o.label")).limit(1).count()
        labels = after
        if not changed:
            break
    border = pairs.join(core.withColumnRenamed("id", "b"), "b").join(core.withColumnRenamed("id", "a"), "a", "left_anti").groupBy(F.col("a").alias("id")).agg(F.min(F.struct("d", "b")).alias("near"))
    joined = labels.union(border.join(labels.withColumnRenamed("id", "_core"), F.col("near.b") == F.col("_core")).select("id", "label"))
    # numbers by rank among the few distinct labels
    names = labels.select("label").distinct().withColumn("number", (F.row_number().over(Window.orderBy("label")) - 1).cast("int"))
    out = rows.select("id").join(joined, "id", "left").join(names, "label", "left")
    return out.select(F.col("id").alias(key), F.coalesce("number", F.lit(-1)).alias("label"))


@persistable
@dataclass
class GaussianMixture:
    names: list[str]
    shares: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    log_likelihood: float
    rounds: int = 0

    def log_densities(self) -> list[Column]:
        x, p, out = [F.col(c) for c in self.names], len(self.names), []
        for w, m, cov in zip(self.shares, self.means, self.covariances, strict=True):
            q, (_, log_det) = np.linalg.inv(cov), np.linalg.slogdet(cov)
            s = F.lit(0.0)
            for i in range(p):
                for j in range(p):
                    s = s + F.lit(float(q[i, j])) * (x[i] - float(m[i])) * (x[j] - float(m[j]))
            out.append(F.lit(float(np.log(w) - 0.5 * (log_det + p * np.log(2 * np.pi)))) - s / 2)
        return out

    def predict(self, df: DataFrame) -> DataFrame:
        logs = F.array(*self.log_densities())
        return df.withColumn("cluster", (F.array_position(logs, F.array_max(logs)) - 1).cast("int"))


def gaussian_mixture(df: DataFrame, features: Sequence[str], start: KMeans, rounds: int = 100, tolerance: float = 1e-3, smoothing: float = 1e-6) -> GaussianMixture:
    """EM from a grouping; a round is one aggregation of shares and weighted products."""
    p, k = len(features), len(start.centres)
    near = start.predict(df)
    first = {r["cluster"]: r for r in near.groupBy("cluster").agg(F.count("*").alias("n"), *[F.covar_pop(a, b).alias(f"c{i}_{j}") for i, a in enumerate(features) for j, b in enumerate(features)]).collect()}
    n = sum(r["n"] for r in first.values())
    eye = smoothing * np.eye(p)
    model = GaussianMixture(list(features), np.array([first[c]["n"] / n for c in range(k)]), start.centres.copy(), np.array([[[first[c][f"c{i}_{j}"] for j in range(p)] for i in range(p)] + eye for c in range(k)]), -np.inf)
    for i in range(1, rounds + 1):
        logs = model.log_densities()
        rows = df.select(*features, F.array(*logs).alias("_l")).withColumn("_top", F.array_max("_l"))
        rows = rows.withColumn("_sum", F.col("_top") + F.log(total(F.transform("_l", lambda v: F.exp(v - F.col("_top"))))))
        r = [F.exp(F.col("_l")[c] - F.col("_sum")) for c in range(k)]
        aggs = [F.avg("_sum").alias("ll"), *[F.sum(r[c]).alias(f"n{c}") for c in range(k)], *[F.sum(r[c] * F.col(a)).alias(f"m{c}_{x}") for c in range(k) for x, a in enumerate(features)], *[F.sum(r[c] * F.col(a) * F.col(b)).alias(f"s{c}_{x}_{y}") for c in range(k) for x, a in enumerate(features) for y, b in enumerate(features) if y <= x]]
        row = rows.agg(*aggs).first()
        weight = np.array([row[f"n{c}"] for c in range(k)])
        means = np.array([[row[f"m{c}_{x}"] for x in range(p)] for c in range(k)]) / weight[:, None]
        second = np.array([[[row[f"s{c}_{max(x, y)}_{min(x, y)}"] for y in range(p)] for x in range(p)] for c in range(k)]) / weight[:, None, None]
        better = row["ll"] - model.log_likelihood
        model = GaussianMixture(list(features), weight / weight.sum(), means, second - means[:, :, None] * means[:, None, :] + eye, float(row["ll"]), i)
        if better < tolerance:
            break
    return model


def agglomerate(points: np.ndarray, k: int, linkage: str = "ward") -> tuple[np.ndarray, list[float]]:
    """(labels by first row, heights) of a bounded set of points (a sample or centres of a table).

    Distances between groups follow the update rule of Lance and Williams.
    """
    n = len(points)
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    size, groups, heights = np.ones(n), {i: [i] for i in range(n)}, []
    while len(groups) > k:
        i, j = divmod(int(np.argmin(d)), n)
        i, j = min(i, j), max(i, j)
        h = d[i, j]
        heights.append(float(h))
        a, b = size[i], size[j]
        if linkage == "single":
            new = np.minimum(d[i], d[j])
        elif linkage == "complete":
            new = np.where(np.isinf(d[i]) | np.isinf(d[j]), np.inf, np.maximum(d[i], d[j]))
        elif linkage == "average":
            new = (a * d[i] + b * d[j]) / (a + b)
        else:
            new = np.sqrt(np.maximum(((a + size) * d[i] ** 2 + (b + size) * d[j] ** 2 - size * h * h) / (a + b + size), 0))
        groups[i] += groups.pop(j)
        size[i] += size[j]
        d[i], d[:, i] = new, new
        d[j], d[:, j] = np.inf, np.inf
        d[i, i] = np.inf
        for x in range(n):
            if x not in groups:
                d[i, x] = d[x, i] = np.inf
    labels = np.zeros(n, int)
    for number, first in enumerate(sorted(groups, key=lambda g: min(groups[g]))):
        labels[groups[first]] = number
    return labels, heights


def self_organising_map(points: np.ndarray, width: int = 4, height: int = 4, epochs: int = 100, rate: tuple[float, float] = (0.5, 0.01), radius: tuple[float, float] = (2.0, 0.5), seed: int = 0) -> np.ndarray:
    """Units (height, width, p) drawn to a bounded set of points, nearest unit and its neighbours."""
    draw = np.random.default_rng(seed)
    grid = np.stack(np.meshgrid(np.arange(height), np.arange(width), indexing="ij"), -1).reshape(-1, 2)
    units = points[draw.integers(0, len(points), height * width)].astype(float)
    for epoch in range(epochs):
        t = epoch / max(epochs - 1, 1)
        step, reach = rate[0] * (rate[1] / rate[0]) ** t, radius[0] + (radius[1] - radius[0]) * t
        for i in draw.permutation(len(points)):
            winner = int(((units - points[i]) ** 2).sum(1).argmin())
            pull = step * np.exp(-((grid - grid[winner]) ** 2).sum(1) / (2 * reach**2))
            units += pull[:, None] * (points[i] - units)
    return units.reshape(height, width, -1)


def assign_to(df: DataFrame, vector: str, codes: np.ndarray, name: str = "code") -> DataFrame:
    """The nearest of bounded codes for each row's array, ties to the lesser number."""
    shared = df.sparkSession.sparkContext.broadcast(np.asarray(codes, float))
    schema = StructType([*df.schema, StructField(name, IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            found = [int(((table - np.asarray(v, float)) ** 2).sum(1).argmin()) for v in batch.column(vector).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], [*batch.schema.names, name])

    return df.mapInArrow(run, schema)


def decoded_from(df: DataFrame, code: str, codes: np.ndarray, name: str = "decoded") -> DataFrame:
    """The code vector of each row's number; null for a number that isn't one."""
    table = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in np.asarray(codes, float)])
    return df.withColumn(name, F.when((F.col(code) >= 0) & (F.col(code) < len(codes)), F.get(table, F.col(code))))
