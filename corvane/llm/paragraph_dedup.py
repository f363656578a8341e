"""Substring dedup: MinHash banding over paragraphs.

There are two kinds of paragraphs. A line with at least ``least_words`` words is one; its set is that of its
``size``-word shingles (A-Z lower-cased), and equal sets are one class. Sixteen MinHash values in eight
bands of two put a pair of similarity 0.8 into a common bucket with a probability of 0.9997. Within
buckets the exact Jaccard similarity decides (``set_join``), and the components of similar lines are the
classes. The first line of a class, by key and line, stays; the others are removals.

Any 50 words in a row are a paragraph, too, wherever lines break: equal ones are found in one band of
one MinHash value, which can't miss them, and those that overlap are joined to passages
(``shared_passages``). So every text that repeats 50 words of another one is found.

Defined cases: null and empty texts have no paragraphs; lines that are shorter and part of no passage are
never removed; repeated rows of one key and text are one document; rows with a null key take part, and
a class has a null key only if it has no other; extra columns aren't looked at; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import Scratch, few
from corvane.llm.components import components
from corvane.llm.ngram_join import shared_buckets, thinned
from corvane.llm.set_join import resolve
from corvane.llm.shared_passages import named, shared, values_of
from corvane.llm.shingles import Batch, batches_of, mix, rolled

BANDS, ROWS = 8, 2
REMEMBERED = 1 << 20
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))
#: Bits of a shingle's hash by which repeats in a line are told; the others hold the line's number in the batch.
_BITS = 40


def line_shingles(x: Batch, size: int, least_words: int) -> tuple[np.ndarray, ...]:
    """(line, words of it, first word, first shingle, shingles) of the paragraphs of a batch, in order.
    Lines are counted from the batch's first one; the shingles of a line are in order, with repeats."""
    line = np.searchsorted(np.flatnonzero(x.raw == 10), x.starts)
    counts = np.bincount(line) if len(line) else np.zeros(0, np.int64)
    shingles = rolled(x.words, size)
    of = line[: len(shingles)]
    at = np.flatnonzero((of == line[size - 1 :][: len(shingles)]) & (counts[of] >= max(least_words, size))) if len(line) >= size else np.zeros(0, np.int64)
    of = of[at]
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else of
    return of[first], counts[of[first]], at[first], first, shingles[at]


def _names(shingles: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A signed 64-bit name of each paragraph's set."""
    n = np.diff(np.append(first, len(shingles)))
    of = np.repeat(np.arange(len(first), dtype=np.uint64), n)
    low = np.uint64((1 << _BITS) - 1)
    tokens = np.sort((of << np.uint64(_BITS)) | (shingles & low))
    tokens = tokens[np.concatenate([[True], tokens[1:] != tokens[:-1]])]
    heads = np.searchsorted(tokens >> np.uint64(_BITS), np.arange(len(first), dtype=np.uint64))
    one, size = mix(tokens & low), np.diff(np.append(heads, len(tokens))).astype(np.uint64)
    return (np.add.reduceat(one, heads) ^ mix(np.bitwise_xor.reduceat(mix(one + np.uint64(1)), heads) + size)).view(np.int64)


def _bands(shingles: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The bucket keys, a row for each paragraph."""
    least = [np.minimum.reduceat((shingles ^ seed) * (seed | np.uint64(1)), first) for seed in _SEEDS]
    keys = []
    for band in range(BANDS):
        key = np.full(len(first), band + 1, np.uint64)
        for row in range(ROWS):
            key = mix(key + least[band * ROWS + row])
        keys.append(key)
    return np.stack(keys, 1).view(np.int64)


def _units(docs: DataFrame, kind: str, size: int, least_words: int, values: bool) -> DataFrame:
    """(key, name, line, start, end, n_words, sid, bands) of each line, and (name, values) of each text with windows.
    The bands of a set that the worker has met already are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for some, x in batches_of(batches):
            line, n, at, first, shingles = line_shingles(x, size, least_words)
            if len(line):
                breaks = np.flatnonzero(x.raw == 10)
                begins = np.concatenate([[0], breaks + 1])
                points = np.concatenate([[0], np.cumsum((x.raw & 0xC0) != 0x80)])
                doc = x.doc[at]
                base, of = points[x.edges[doc]], pa.array(doc)
                names = _names(shingles, first)
                new = np.array([y not in known for y in names.tolist()])
                known = known if len(known) < REMEMBERED else set()
                known.update(names.tolist())
                fresh = np.flatnonzero(new)
                ends = np.append(first[1:], len(shingles))
                bands = np.zeros((len(first), 0), np.int64)
                if len(fresh):
                    which = np.concatenate([np.arange(first[i], ends[i]) for i in fresh])
                    bands = _bands(shingles[which], np.cumsum(ends[fresh] - first[fresh]) - (ends[fresh] - first[fresh]))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(new, BANDS, 0))]).astype(np.int32)), pa.array(bands.ravel()))
                own = line - np.searchsorted(breaks, x.edges)[doc]
                columns = [some.column("key").take(of), some.column("name").take(of), *(pa.array(y.astype(np.int64)) for y in (own, points[begins[line]] - base, points[breaks[line]] - base, n)), pa.array(names), lists, pa.nulls(len(line), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, _COLUMNS)
            if values:
                found, doc = values_of(x)
                if len(found):
                    heads = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                    of = pa.array(doc[heads])
                    lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(doc)).astype(np.int32)), pa.array(found.view(np.int64)))
                    empty = [pa.nulls(len(heads), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays([some.column("key").take(of), some.column("name").take(of), *empty, lists], _COLUMNS)

    return docs.mapInArrow(run, f"key {kind}, name long, line long, start long, end long, n_words long, sid long, bands array<long>, values array<long>")


_COLUMNS = ["key", "name", "line", "start", "end", "n_words", "sid", "bands", "values"]


def _buckets(units: DataFrame, sid: str, keys: str) -> DataFrame:
    """(key, salt, sid) of the lists ``keys``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 10_000):
                lists = batch.column("keys").slice(at, 10_000)
                sizes = np.diff(lists.offsets.to_numpy())
                yield thinned(lists.flatten().to_numpy(), np.repeat(batch.column("sid").slice(at, 10_000).to_numpy(), sizes))

    return units.where(F.size(keys) > 0).select(F.col(sid).alias("sid"), F.col(keys).alias("keys")).mapInArrow(run, "key long, salt int, sid long")


def _sets(docs: DataFrame, size: int, least_words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, x in batches_of(batches):
            _, _, _, first, shingles = line_shingles(x, size, least_words)
            if not len(first):
                continue
            wanted = np.unique(some.column("sids").flatten().to_numpy())
            names, ends = _names(shingles, first), np.append(first[1:], len(shingles))
            rows = np.flatnonzero(np.isin(names, wanted))
            sets = [np.unique(shingles[first[i] : ends[i]]) for i in rows]
            yield pa.RecordBatch.from_arrays([pa.array(names[rows]), pa.array([len(y) for y in sets], pa.int64()), pa.array([y.astype("<u8").tobytes() for y in sets], pa.binary())], ["sid", "n", "hashes"])

    return docs.mapInArrow(run, "sid long, n long, hashes binary")


def _classes(units: DataFrame, docs: DataFrame, scratch: Scratch, size: int, num: int, den: int, least_words: int) -> DataFrame:
    rows = scratch.table(units.where("line is not null").select("key", "name", "line", "start", "end", "n_words", "sid").dropDuplicates(["name", "line"]), "paragraphs")
    members = scratch.table(shared_buckets(_buckets(units, "sid", "bands")), "members")
    # each set is taken from one text that has it
    holder = rows.join(members.select("sid").distinct(), "sid", "left_semi").groupBy("sid").agg(F.min("name").alias("name"))
    wanted = scratch.table(holder.groupBy("name").agg(F.collect_list("sid").alias("sids")), "wanted")
    some = docs.join(few(wanted.select("name")), "name", "left_semi").join(wanted, "name")
    sets = scratch.table(_sets(some.select("text", "sids"), size, least_words).dropDuplicates(["sid"]), "sets")
    links = resolve(members, sets, scratch, num, den)
    found = components(links, scratch, "links").select(F.col("id").alias("sid"), "component")
    scratch.drop("members", "sets", "wanted")
    key = F.struct(F.col("key").isNull().alias("unnamed"), "key", "line")
    of_set = rows.groupBy("sid").agg(F.min(key).alias("first"), F.count("*").alias("n")).join(found, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    of_class = of_set.groupBy("component").agg(F.min("first").alias("first"), F.sum("n").alias("n")).where("n > 1")
    by_set = scratch.table(of_set.select("sid", "component").join(of_class.select("component", "first"), "component").select("sid", "first"), "class_of_set")
    stays = F.col("key").eqNullSafe(F.col("first.key")) & (F.col("line") == F.col("first.line"))
    return rows.join(by_set, "sid").select("key", "line", "start", "end", "n_words", F.col("first.key").alias("class_key"), F.col("first.line").alias("class_line"), (~stays).alias("removed"))


def classes(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", size: int = 5, num: int = 80, den: int = 100, least_words: int = 20) -> DataFrame:
    """(key, line, start, end, n_words, class_key, class_line, removed): every line that has a like one, with
    the first of its class; places are in code points."""
    some = named(docs, key, text)
    units = scratch.table(_units(some, docs.schema[key].dataType.simpleString(), size, least_words, False), "units")
    result = scratch.table(_classes(units, some, scratch, size, num, den, least_words).withColumnRenamed("key", key), "result", stay=True)
    scratch.drop()
    return result


def repeats(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", size: int = 5, num: int = 80, den: int = 100, least_words: int = 20) -> DataFrame:
    """(key, kind, line, start, end, n_words, class_key, class_line, removed): the rows of ``classes``, of kind
    line, and the passages of ``shared_passages``, of kind passage and without lines."""
    some = named(docs, key, text)
    units = scratch.table(_units(some, docs.schema[key].dataType.simpleString(), size, least_words, True), "units")
    runs = scratch.table(shared(docs, scratch, key, text, _buckets(units, "name", "values")).withColumnRenamed(key, "key"), "passages")
    lines = _classes(units, some, scratch, size, num, den, least_words)
    none = F.lit(None).cast("long")
    columns = ["key", "kind", "line", "start", "end", "n_words", "class_key", "class_line", "removed"]
    both = lines.withColumn("kind", F.lit("line")).select(columns).union(runs.withColumns({"kind": F.lit("passage"), "line": none, "class_line": none}).select(columns))
    result = scratch.table(both.withColumnRenamed("key", key), "result", stay=True)
    scratch.drop()
    return result
