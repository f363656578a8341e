"""Neighbour searches: a stated query set against all rows, in blocks.

Queries are taken in blocks of ``BLOCK_BYTES``, each broadcast by itself, so what is broadcast at once has a
bound in bytes. A task compares its rows with a block by matrix operations on Arrow batches, and keeps
the k best of its rows for every query before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.errors import InvalidParameter
from corvane.functions.vectors import dot, norm
from corvane.scratch import written

#: Bytes of a block of queries, and values of the largest array of a comparison.
BLOCK_BYTES, VALUES = 16 << 20, 1 << 22
#: Of ``kernel_values``: pairs of a task, and of a tile, whose arrays should stay in a core's cache.
PAIRS, TILE = 4_000_000, 1 << 15


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    if not len(column):
        return np.zeros((0, 0))
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    if len(values) % len(column) or np.unique(np.diff(column.offsets.to_numpy())).size > 1:
        raise InvalidParameter("vectors of different lengths")
    return values.reshape(len(column), -1)


def _gaps(part: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    def measure(q: np.ndarray, r: np.ndarray) -> np.ndarray:
        step = max(1, VALUES // max(q.size, 1))
        return np.concatenate([part(q[:, None, :] - r[None, i : i + step, :]) for i in range(0, len(r), step)], axis=1)

    return measure


def _cosine(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    unit = lambda x: x / np.where((n := np.sqrt((x * x).sum(1))) == 0, 1, n)[:, None]
    return np.clip(1 - unit(q) @ unit(r).T, 0, 2)


def _canberra(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    out = np.zeros((len(q), len(r)))
    for i in range(q.shape[1]):
        top, bottom = np.abs(q[:, i, None] - r[None, :, i]), np.abs(q[:, i, None]) + np.abs(r[None, :, i])
        out += np.divide(top, bottom, out=np.zeros_like(top), where=bottom > 0)
    return out


#: (queries, dimension), (rows, dimension) -> (queries, rows)
MEASURES: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "euclidean": _gaps(lambda x: np.sqrt(np.einsum("ijk,ijk->ij", x, x))),
    "manhattan": _gaps(lambda x: np.abs(x).sum(2)),
    "chebyshev": _gaps(lambda x: np.abs(x).max(2)),
    "hamming": _gaps(lambda x: (x != 0).mean(2)),
    "cosine": _cosine,
    "canberra": _canberra,
    "inner": lambda q, r: -(q @ r.T),
}


def _blocks(queries: DataFrame) -> Iterator[pa.Table]:
    """The queries (query_id, _q), block by block; a block comes to the driver when it is its turn."""
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("_q")).alias("d")).first()
    n = max(1, -(-size["n"] * ((size["d"] or 0) * 8 + 16) // BLOCK_BYTES))
    parts = (queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i).toArrow() for i in range(n))
    return (x for x in parts if x.num_rows)


def _scored(rows: DataFrame, block: pa.Table, metric: str, k: int | None, radius: float | None, excluding_self: bool) -> DataFrame:
    """(query_id, row_id, distance) of a block's queries: the k best of every batch, or all within the radius."""
    measure = MEASURES[metric]
    spark = rows.sparkSession
    ids, matrix = block.column("query_id").combine_chunks(), _matrix(block.column("_q").combine_chunks())
    shared = spark.sparkContext.broadcast((ids, matrix))
    kinds = rows.schema["row_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        step = max(1, VALUES // max(len(q), 1))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                names = batch.column("row_id")
                d = measure(q, _matrix(batch.column("_r")))
                if excluding_self:
                    own = pa.compute.index_in(names, ids).to_numpy(zero_copy_only=False)
                    here = np.flatnonzero(~np.isnan(own.astype(float)))
                    d[own[here].astype(int), here] = np.inf
                if radius is not None:
                    i, j = np.nonzero(d <= radius)
                elif k >= d.shape[1]:
                    i, j = np.nonzero(d < np.inf)
                else:
                    limit = np.partition(d, k - 1, axis=1)[:, k - 1]  # ties of the k-th stay, so that ids decide
                    i, j = np.nonzero((d <= limit[:, None]) & (d < np.inf))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), names.take(pa.array(j)), pa.array(d[i, j])], ["query_id", "row_id", "distance"])

    return rows.mapInArrow(run, f"query_id {kinds}, row_id {kinds}, distance double")


def _search(queries: DataFrame, rows: DataFrame, metric: str, names: tuple[str, str, str], k: int | None = None, radius: float | None = None, excluding_self: bool = False) -> DataFrame:
    query_id, row_id, vector = names
    if metric not in MEASURES:
        raise InvalidParameter(f"metric: {metric}")
    kind = rows.schema[row_id].dataType
    q = queries.select(F.col(query_id).cast(kind).alias("query_id"), F.col(vector).cast("array<double>").alias("_q"))
    r = rows.select(F.col(row_id).alias("row_id"), F.col(vector).cast("array<double>").alias("_r"))
    order = Window.partitionBy("query_id").orderBy("distance", "row_id")
    ranked = lambda df: df if k is None else df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    out = last = None
    for block in _blocks(q):
        if last is not None:  # one of several blocks: done before the next one is fetched
            last = written(last, "neighbours")
            out = last if out is None else out.unionByName(last)
        last = ranked(_scored(r, block, metric, k, radius, excluding_self))
    if last is None:
        return ranked(q.select("query_id", F.col("query_id").alias("row_id"), F.lit(0.0).alias("distance")).where("false"))
    return last if out is None else out.unionByName(last)


def nearest(queries: DataFrame, rows: DataFrame, k: int, metric: str = "euclidean", query_id: str = "query_id", row_id: str = "row_id", vector: str = "vector", excluding_self: bool = False) -> DataFrame:
    """(query_id, row_id, distance, rank): the k nearest rows of each query, ties to the lesser row id."""
    if k < 1:
        raise InvalidParameter(f"k: {k}")
    return _search(queries, rows, metric, (query_id, row_id, vector), k=k, excluding_self=excluding_self)


def within(queries: DataFrame, rows: DataFrame, radius: float, metric: str = "euclidean", query_id: str = "query_id", row_id: str = "row_id", vector: str = "vector") -> DataFrame:
    """(query_id, row_id, distance): all rows at most ``radius`` away."""
    return _search(queries, rows, metric, (query_id, row_id, vector), radius=radius)


#: (products, squared distances) -> values
KERNELS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "linear": lambda k, g: k,
    "polynomial": lambda k, g: (k + 1) ** 3,
    "radial": lambda k, g: np.exp(-g),
    "sigmoid": lambda k, g: np.tanh(k),
}


def _half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """Halves away from zero, as SQL's round; what overflows stays, and -0.0 becomes 0.0."""
    scaled = x * 10.0**digits
    whole = np.trunc(scaled)
    whole += np.copysign(np.abs(scaled - whole) >= 0.5, scaled)
    out = whole / 10.0**digits
    return np.where(np.isfinite(out), out, x) + 0.0


def _known(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The matrix of the lists that aren't null, and which these are."""
    return _matrix(column.drop_null()), column.is_valid().to_numpy(zero_copy_only=False)


def _tile(q: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Products and squared distances of (dimension, queries) and (rows, dimension), summed in the order of dimensions."""
    k, g, part = (np.zeros((len(r), q.shape[1])) for _ in range(3))
    for i in range(len(q)):
        np.multiply(r[:, i, None], q[None, i], out=part)
        k += part
        np.subtract(r[:, i, None], q[None, i], out=part)
        part *= part
        g += part
    return k, g


def kernel_values(queries: DataFrame, rows: DataFrame, query_id: str = "query_id", row_id: str = "row_id", vector: str = "vector", kinds: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = KERNELS, digits: int | None = None) -> DataFrame:
    """(query_id, row_id, a column for each kernel) of every query and every row, rounded where they are made;
    null where a vector is null or has a null. The rows are dealt out by their number alone, so that
    each task has about ``PAIRS`` pairs however few files there are."""
    kind = rows.schema[row_id].dataType
    whole = lambda c: F.when(~F.exists(c, lambda x: x.isNull()), F.col(c).cast("array<double>"))
    q = queries.select(F.col(query_id).cast(kind).alias("query_id"), whole(vector).alias("_q"))
    r = rows.select(F.col(row_id).alias("row_id"), whole(vector).alias("_r"))
    n = r.count()
    schema = f"query_id {kind.simpleString()}, row_id {kind.simpleString()}, " + ", ".join(f"{c} double" for c in kinds)

    def valued(block: pa.Table) -> DataFrame:
        matrix, there = _known(block.column("_q").combine_chunks())
        shared = rows.sparkSession.sparkContext.broadcast((block.column("query_id").combine_chunks(), np.ascontiguousarray(matrix.T), there))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, points, there = shared.value
            full = np.zeros((len(points), len(ids)))
            full[:, there] = points
            for batch in batches:
                own, here = _known(batch.column("_r"))
                if there.any() and here.any() and own.shape[1] != len(full):
                    raise InvalidParameter("vectors of different lengths")
                r = np.zeros((len(here), len(full)))
                if there.any() and here.any():
                    r[here] = own
                wide = min(len(ids), TILE)
                tall = max(1, TILE // wide)
                for i in range(0, len(r), tall):
                    for j in range(0, len(ids), wide):
                        with np.errstate(over="ignore", invalid="ignore"):
                            k, g = _tile(full[:, j : j + wide], r[i : i + tall])
                            values = [f(k, g) for f in kinds.values()]
                            values = [v if digits is None else _half_up(v, digits) for v in values]
                        lost = None if here.all() and there.all() else ~(here[i : i + tall, None] & there[None, j : j + wide]).ravel()
                        a, b = np.tile(np.arange(j, j + k.shape[1]), len(k)), np.repeat(np.arange(i, i + len(k)), k.shape[1])
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), batch.column("row_id").take(pa.array(b)), *[pa.array(v.ravel(), mask=lost) for v in values]], ["query_id", "row_id", *kinds])

        return r.repartition(max(1, -(-n * block.num_rows // PAIRS))).mapInArrow(run, schema)

    out = None
    for block in _blocks(q):
        part = valued(block)
        out = part if out is None else out.unionByName(part)
    return rows.sparkSession.createDataFrame([], schema) if out is None else out


def regress(neighbours: DataFrame, rows: DataFrame, value: str, row_id: str = "row_id") -> DataFrame:
    """(query_id, prediction): the neighbours' mean value."""
    return neighbours.join(rows.select(F.col(row_id).alias("row_id"), F.col(value).alias("_v")), "row_id").groupBy("query_id").agg(F.avg("_v").alias("prediction"))


def classify(neighbours: DataFrame, rows: DataFrame, label: str, row_id: str = "row_id") -> DataFrame:
    """(query_id, prediction, share): the commonest label, ties to the lesser one."""
    votes = neighbours.join(rows.select(F.col(row_id).alias("row_id"), F.col(label).alias("_l")), "row_id").groupBy("query_id", "_l").agg(F.count("*").alias("_n"))
    best = votes.groupBy("query_id").agg(F.max(F.struct("_n", (-F.col("_l")).alias("_m"))).alias("b"), F.sum("_n").alias("_k"))
    return best.select("query_id", (-F.col("b._m")).alias("prediction"), (F.col("b._n") / F.col("_k")).alias("share"))


def _unit(df: DataFrame, vector: str) -> DataFrame:
    """Rows of zeros are skipped."""
    return df.withColumn("_n", norm(F.col(vector))).where("_n > 0").withColumn(vector, F.transform(vector, lambda x: x / F.col("_n"))).drop("_n")


def most_similar(queries: DataFrame, rows: DataFrame, k: int, query_id: str = "query_id", row_id: str = "row_id", vector: str = "vector", excluding_self: bool = False) -> DataFrame:
    """(query_id, row_id, similarity, rank) by cosine; rows of zeros are skipped."""
    out = nearest(_unit(queries, vector), _unit(rows, vector), k, "inner", query_id, row_id, vector, excluding_self)
    return out.withColumn("similarity", -F.col("distance")).drop("distance")


def analogy(rows: DataFrame, triples: DataFrame, k: int = 1, row_id: str = "row_id", vector: str = "vector") -> DataFrame:
    """(query_id, row_id, similarity, rank): of triples (query_id, a, b, c), the rows nearest to b - a + c by
    cosine; a, b and c themselves are left out."""
    unit = _unit(rows.select(F.col(row_id).alias("row_id"), F.col(vector).alias("v")), "v")
    points = triples
    for side in ("a", "b", "c"):
        points = points.join(unit.select(F.col("row_id").alias(side), F.col("v").alias(f"_{side}")), side)
    target = F.zip_with(F.zip_with("_b", "_a", lambda x, y: x - y), "_c", lambda x, y: x + y)
    found = most_similar(points.select("query_id", target.alias("v")), unit, k + 3, vector="v")
    kept = found.join(triples, "query_id").where(~F.col("row_id").isin(F.col("a"), F.col("b"), F.col("c")))
    order = Window.partitionBy("query_id").orderBy("rank")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "row_id", "similarity", "rank")


def similarity(pairs: DataFrame, rows: DataFrame, row_id: str = "row_id", vector: str = "vector") -> DataFrame:
    """(a, b, similarity) of pairs (a, b) of rows, by cosine; null where a row is all zeros."""
    v = rows.select(F.col(row_id).alias("_id"), F.col(vector).alias("_v"))
    both = pairs.join(v.select(F.col("_id").alias("a"), F.col("_v").alias("_x")), "a").join(v.select(F.col("_id").alias("b"), F.col("_v").alias("_y")), "b")
    length = norm(F.col("_x")) * norm(F.col("_y"))
    return both.select("a", "b", F.when(length > 0, dot(F.col("_x"), F.col("_y")) / length).alias("similarity"))


__all__ = ["analogy", "classify", "kernel_values", "most_similar", "nearest", "regress", "similarity", "within"]