"""Passages that stand in several documents, wherever their lines break.

A paragraph here is a window: any 50 words in a row (A-Z lower-cased, white space of any kind between
them). Every window that two or more documents hold is found:

1. Banding. A window has 26 shingles of 25 words, and the least of their hashes is its MinHash value: one
   band of one row, as equal windows always have equal ones. A document has few different values, one for
   some 13 words, and those that no other document has are dropped.
2. Exact comparison. The windows of one value are a segment; the segments that share a value meet, and
   their windows are compared by 64-bit hash. Of a value with more than ``HOT`` segments the windows are
   pre-aggregated instead, so that no task gets all of them.
3. Shared windows that overlap or touch make passages, apart for those to remove and those that stay:
   the least key that holds a window keeps it, and in the other documents it is removed.

Defined cases: null and empty texts have no windows, nor have texts under 50 words; rows of one key are
one document, and so are rows with a null key, which is greater than all others; extra columns aren't
looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.common import Scratch, few
from corvane.llm.ngram_join import shared_buckets, thinned
from corvane.llm.shingles import Batch, batches_of, mix, powers

#: Words of a window and of a shingle; a window has SIZE - HALF + 1 shingles.
SIZE, HALF = 50, 25
#: Segments of one value that may meet in a task.
HOT = 2_000


def windows_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, MinHash value) of each window, in order."""
    n = len(words)
    if n < SIZE:
        return words[:0], words[:0]
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * up[:n], out=sums[1:])
    half = mix((sums[HALF:] - sums[:-HALF]) * down[: n - HALF + 1])
    whole = mix(half[: n - SIZE + 1] * np.uint64(3) + half[HALF : HALF + n - SIZE + 1])
    least, span, want = half, 1, SIZE - HALF + 1
    while span * 2 <= want:
        least, span = np.minimum(least[:-span], least[span:]), span * 2
    return whole, np.minimum(least[: n - SIZE + 1], least[want - span :][: n - SIZE + 1])


def batch_windows(x: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, hash, MinHash value) of the windows that stand in one text."""
    hashes, values = windows_of(x.words)
    at = np.flatnonzero(x.doc[: len(hashes)] == x.doc[SIZE - 1 :][: len(hashes)])
    return at, hashes[at], values[at]


def values_of(x: Batch) -> tuple[np.ndarray, np.ndarray]:
    """(value, number of the text): the different values of each text."""
    at, _, values = batch_windows(x)
    new = np.flatnonzero(np.concatenate([[True], (values[1:] != values[:-1]) | (x.doc[at][1:] != x.doc[at][:-1])])) if len(at) else at
    return values[new], x.doc[at[new]]


def named(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name, text): the name is a hash of key and text, so repeated rows have the same."""
    return docs.select(F.col(key).alias("key"), F.xxhash64(F.col(key), F.col(text)).alias("name"), F.col(text).alias("text"))


def _values(docs: DataFrame) -> DataFrame:
    """(key, salt, sid): each text's values, as key, with its name, as sid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, x in batches_of(batches):
            values, of = values_of(x)
            yield thinned(values.view(np.int64), some.column("name").to_numpy()[of])

    return docs.mapInArrow(run, "key long, salt int, sid long")


def _segments(docs: DataFrame, kind: str) -> DataFrame:
    """(value, key, name, at, windows, starts, ends): the windows of each value in ``values``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, x in batches_of(batches):
            lists = some.column("values")
            wanted = np.unique(lists.flatten().to_numpy())
            at, hashes, values = batch_windows(x)
            # a value that another text of the batch shares may be in more texts than asked for, and does no harm
            keep = np.isin(values.view(np.int64), wanted)
            at, hashes, values = at[keep], hashes[keep], values[keep]
            if not len(at):
                continue
            first = np.flatnonzero(np.concatenate([[True], (values[1:] != values[:-1]) | (at[1:] != at[:-1] + 1) | (x.doc[at][1:] != x.doc[at][:-1])]))
            offsets = pa.array(np.append(first, len(at)).astype(np.int32))
            start, end = x.points(at, at + SIZE - 1)
            of = pa.array(x.doc[at[first]])
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (hashes.view(np.int64), start, end)]
            yield pa.RecordBatch.from_arrays([pa.array(values[first].view(np.int64)), some.column("key").take(of), some.column("name").take(of), pa.array(at[first] - x.first_word[x.doc[at[first]]]), *lists], ["value", "key", "name", "at", "windows", "starts", "ends"])

    return docs.mapInArrow(run, f"value long, key {kind}, name long, at long, windows array<long>, starts array<long>, ends array<long>")


RANGE = "key {0}, name long, first {0}, at long, until long, start long, end long"


def _compared(batch: pa.Table) -> pa.Table:
    """The ranges of shared windows, of all segments of some values."""
    keys = batch.column("key").combine_chunks()
    order = pc.sort_indices(batch.select(["key"]), sort_keys=[("key", "ascending")], null_placement="at_end").to_numpy()
    rank = np.empty(len(keys), np.int64)
    distinct = pc.rank(keys, sort_keys="ascending", null_placement="at_end", tiebreaker="min").to_numpy() if len(keys) else rank
    rank[:] = distinct
    lists = batch.column("windows").combine_chunks()
    sizes = pc.list_value_length(lists).to_numpy()
    of = np.repeat(np.arange(len(keys)), sizes)
    names = mix(lists.flatten().to_numpy().view(np.uint64) ^ mix(batch.column("value").to_numpy().view(np.uint64))[of])
    by = np.lexsort((rank[of], names))
    heads = np.flatnonzero(np.concatenate([[True], names[by][1:] != names[by][:-1]]))
    low, high = rank[of][by[heads]], rank[of][by[np.append(heads[1:], len(by)) - 1]]
    runs = np.diff(np.append(heads, len(by)))
    owner, shared = np.empty(len(by), np.int64), np.empty(len(by), bool)
    owner[by], shared[by] = np.repeat(low, runs), np.repeat(low != high, runs)
    place = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    kept = np.flatnonzero(shared)
    o, f, p = owner[kept], of[kept], place[kept]
    first = np.flatnonzero(np.concatenate([[True], (f[1:] != f[:-1]) | (o[1:] != o[:-1]) | (p[1:] != p[:-1] + 1)])) if len(kept) else kept
    last = np.append(first[1:], len(kept)) - 1 if len(kept) else kept
    holder = np.empty(int(rank.max(initial=0)) + 1, np.int64)
    holder[rank[order[::-1]]] = order[::-1]
    rows, at = pa.array(f[first]), batch.column("at").to_numpy()[f[first]]
    starts, ends = (batch.column(c).combine_chunks().flatten().to_numpy() for c in ("starts", "ends"))
    return pa.table({"key": keys.take(rows), "name": batch.column("name").combine_chunks().take(rows), "first": keys.take(pa.array(holder[o[first]])), "at": at + p[first], "until": at + p[last], "start": starts[kept[first]], "end": ends[kept[last]]})


def _meet(segments: DataFrame, kind: str) -> DataFrame:
    """Ranges of shared windows; the segments of a value come one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            values = batch.column("value").to_numpy()
            if not len(values):
                continue
            cut = int(np.searchsorted(values, values[-1], "left"))  # the last value may go on in the next batch
            if cut or (held and held[0].column("value")[-1].as_py() != values[0]):
                yield from _compared(pa.Table.from_batches([*held, batch.slice(0, cut)])).combine_chunks().to_batches()
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from _compared(pa.Table.from_batches(held)).combine_chunks().to_batches()

    return segments.repartition("value").sortWithinPartitions("value").mapInArrow(run, RANGE.format(kind))


def _hot(segments: DataFrame) -> DataFrame:
    """The same of values with very many segments: windows are pre-aggregated, and joins can be split."""
    flat = segments.select("key", "name", "value", F.col("at").alias("from"), F.posexplode(F.arrays_zip("windows", "starts", "ends")).alias("i", "w"))
    flat = flat.select("key", "name", "value", (F.col("from") + F.col("i")).alias("at"), F.col("w.windows").alias("window"), F.col("w.starts").alias("start"), F.col("w.ends").alias("end"))
    several = (F.col("first") != F.col("last")) | (F.col("first").isNotNull() & (F.col("nulls") > 0))
    owners = flat.groupBy("value", "window").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.count_if(F.col("key").isNull()).alias("nulls")).where(several).select("value", "window", "first")
    return flat.join(owners.repartition("first", "window"), ["value", "window"]).select("key", "name", "first", "at", F.col("at").alias("until"), "start", "end")


def shared(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", values: DataFrame | None = None) -> DataFrame:
    """(key, start, end, n_words, removed, class_key): every passage of shared windows, its place in code
    points, and the least key that holds one of them. ``values``: those of ``docs``, where they are known."""
    kind = docs.schema[key].dataType.simpleString()
    some = named(docs, key, text)
    both = shared_buckets(values if values is not None else _values(some.select("name", "text")))
    lists = scratch.table(both.groupBy(F.col("sid").alias("name")).agg(F.collect_list("key").alias("values")), "lists")
    candidates = some.join(few(lists.select("name")), "name", "left_semi").join(lists, "name")
    segments = scratch.table(_segments(candidates, kind), "segments")
    scratch.drop("lists")
    hot = F.broadcast(scratch.table(segments.groupBy("value").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("value"), "hot"))
    ranges = scratch.table(_meet(segments.join(hot, "value", "left_anti"), kind).unionByName(_hot(segments.join(hot, "value"))).distinct(), "ranges")
    scratch.drop("segments")
    of = Window.partitionBy("name", "removed").orderBy("at", "until")
    reach = F.max("until").over(of.rowsBetween(Window.unboundedPreceding, -1))
    runs = ranges.withColumn("removed", ~F.col("key").eqNullSafe(F.col("first"))).withColumn("begins", F.coalesce((F.col("at") - reach > SIZE).cast("int"), F.lit(1))).withColumn("run", F.sum("begins").over(of))
    out = runs.groupBy("name", "removed", "run").agg(F.min("key").alias("key"), F.min("start").alias("start"), F.max("end").alias("end"), (F.max("until") - F.min("at") + SIZE).alias("n_words"), F.min("first").alias("class_key"))
    return out.select(F.col("key").alias(key), "start", "end", "n_words", "removed", "class_key")


def passages(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, end, n_words, removed): every passage of shared windows, its place in code points."""
    result = scratch.table(shared(docs, scratch, key, text).drop("class_key"), "result", stay=True)
    scratch.drop()
    return result
