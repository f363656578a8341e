"""Exact removal of repeated byte strings, by prefix-free parsing.

A trigger is the least rolling hash of ``GRAM`` bytes in a window of ``least`` bytes (the first of
equal ones), so every window of that length has one, and equal windows have the same. The windows
that share a trigger, with the bytes they reach, are a phrase; a text is its row of phrases, the
parse, and the corpus's distinct phrases are the dictionary. Phrases overlap by so much that every
window stands in one phrase as a whole, so the first ``least`` bytes of any suffix of the corpus are
those of a suffix of a phrase:

* suffix array of the dictionary: the phrases' suffixes in the order of their first ``least`` bytes,
  with neighbours that have that many in common. Equal windows lie beside equal triggers and agree
  for half of what a window has beside it, on one side, so the array is made in blocks, one for each
  trigger and side, of at most ``hot`` phrases. Suffixes whose fingerprint no other one of the block has
  can't have such a neighbour and are left out of it; the others are compared by their bytes;
* the parse has the places of each phrase. It needs no suffix array of its own: a comparison ends
  inside a phrase, and among equal suffixes the order of the corpus is the order of places;
* corpus order: of suffixes that are equal for ``least`` bytes the first place, over all places of
  their phrases, stays, and every other one is a repeat. An occurrence of a phrase whose first
  occurrence is elsewhere is a repeat as a whole.

Phrases are told apart by 128 bits of hashes (trigger and phrase). A phrase that stands in a third of
all texts is pre-aggregated to its first place before shuffling, and joins on it can be split; the
windows of more than ``hot`` different phrases that agree on a side are pre-aggregated likewise, by
128 bits of hashes, instead of sorted in one task.

Defined cases: a null text is empty; rows with equal keys and texts are one document and get the same
result; of rows with equal keys and other texts the order is by a hash of the text; null keys come
first; keys are integers or strings (other types are refused); texts under ``least`` bytes keep
everything; extra columns aren't looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

from corvane.errors import InvalidParameter
from corvane.llm.common import Scratch, few, sliced
from corvane.llm.shingles import mix, powers

GRAM = 24
#: Windows of a text that are parsed at once; the next part starts a phrase of its own.
PART = 1 << 20


def _sums(raw: np.ndarray) -> np.ndarray:
    up, _ = powers(len(raw) + 1)
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=out[1:])
    return out


def _hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start])


def _least(x: np.ndarray, span: int) -> np.ndarray:
    """The least of each ``span`` neighbours."""
    size = 1
    while 2 * size <= span:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (span - size)], x[span - size :]) if span > size else x


def phrases(raw: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(trigger, phrase, place, sides) of a text of ``least`` bytes or more."""
    sums, n = _sums(raw), len(raw)
    at = np.arange(n - GRAM + 1)
    grams = _hash(sums, at, at + GRAM)
    low = np.uint64(0xFFFFFFFF)
    chosen = (_least((grams & ~low) | at.astype(np.uint64), least - GRAM + 1) & low).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(chosen[1:] != chosen[:-1]) + 1])
    last = np.concatenate([first[1:] - 1, [len(chosen) - 1]])
    g, half = chosen[first], (least - GRAM + 1) // 2
    # a place: the first window, the trigger's distance from it, and the last window's
    place = (first << 20) | ((g - first) << 10) | (last - first)
    whole = _hash(sums, first, last + least) ^ mix((place & 0xFFFFF).astype(np.uint64))
    left = _hash(sums, np.maximum(g - half, 0), g) >> np.uint64(32)
    right = _hash(sums, g + GRAM, np.minimum(g + GRAM + half, n)) >> np.uint64(32)
    return grams[g], whole, place, left << np.uint64(32) | right


def _bytes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for x in batch.column("text").to_pylist():
        yield np.frombuffer(x.encode("utf-8", "surrogatepass"), np.uint8)


def suffix_order(raw: np.ndarray, begin: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(the suffixes that begin there, in the order of their first ``least`` bytes; whether each has those
    in common with the one before it)."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    words = np.zeros(len(raw) + 1, np.uint64)
    for i in range(8):
        words = (words << np.uint64(8)) | padded[i : i + len(words)].astype(np.uint64)
    columns = [words[begin + at] >> np.uint64(8 * max(0, at + 8 - least)) for at in range(0, least, 8)]
    order = np.lexsort(columns[::-1])
    same = np.zeros(len(order), bool)
    if len(order):
        same[1:] = np.logical_and.reduce([c[order][1:] == c[order][:-1] for c in columns])
    return order, same


def _parse(source: DataFrame, least: int) -> DataFrame:
    """(trigger, phrase, k, th, at, sides): the phrases of each text and their places in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out, keys, counts = [], [], []
            for i, raw in enumerate(_bytes(batch)):
                for start in range(0, max(len(raw) - least + 1, 0), PART):
                    t, p, place, sides = phrases(raw[start : start + PART + least - 1], least)
                    out.append((t, p, place + (start << 20), sides))
                    keys.append(i)
                    counts.append(len(t))
                if sum(counts) > 100_000 or (i == batch.num_rows - 1 and out):
                    t, p, place, sides = (np.concatenate(x) for x in zip(*out, strict=True))
                    rows = pa.array(np.repeat(keys, counts))
                    yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(p.view(np.int64)), batch.column("k").take(rows), batch.column("th").take(rows), pa.array(place), pa.array(sides.view(np.int64))], ["trigger", "phrase", "k", "th", "at", "sides"])
                    out, keys, counts = [], [], []

    return source.mapInArrow(run, f"trigger long, phrase long, k {source.schema['k'].dataType.simpleString()}, th int, at long, sides long")


def _parts(at: np.ndarray, sides: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the entry, first window, last window): of each entry, the windows that reach half of
    their rest to the left of the trigger (sides & 1), and the others (sides & 2)."""
    half = (least - GRAM + 1) // 2
    first, last = at >> 20, (at >> 20) + (at & 1023)
    split = np.clip(first + ((at >> 10) & 1023) - half, first - 1, last)  # the last of the left ones
    n = np.arange(len(at))
    entry, a, b = np.concatenate([n, n]), np.concatenate([first, split + 1]), np.concatenate([split, last])
    keep = np.concatenate([(sides & 1) > 0, (sides & 2) > 0]) & (a <= b)
    return entry[keep], a[keep], b[keep]


def repeats(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", least: int = 100, hot: int = 4_000) -> tuple[DataFrame, DataFrame]:
    """(the texts, with columns key, k, th, text; the repeated ranges (k, th, start, end) in bytes).

    A range may overlap others; the texts' k and th name a document.
    """
    if not GRAM < least < 1024:
        raise InvalidParameter(f"least: {least} is not over {GRAM} and under 1024")
    kind = docs.schema[key].dataType
    if isinstance(kind, StringType):
        place_of, k_type, k_arrow = F.when(F.col(key).isNull(), "").otherwise(F.concat(F.lit("+"), F.col(key))), "string", pa.string()
    elif isinstance(kind, IntegralType):
        place_of, k_type, k_arrow = F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))), "long", pa.int64()
    else:
        raise InvalidParameter(f"{key}: {kind.simpleString()} is neither an integer nor a string")
    source = docs.select(F.col(key).alias("key"), place_of.alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("th", F.hash("text"))
    parsed = _parse(source.select("k", "th", "text"), least)
    # dealt out once more, so that Spark can split the join at a trigger that very many texts have
    again = parsed.groupBy("trigger").agg(F.count("*").alias("n")).where("n > 1").repartition("trigger", "n").select("trigger")
    rows = scratch.table(parsed.join(again, "trigger"), "phrases")
    place = F.struct("k", "th", "at")
    entries = scratch.table(rows.groupBy("trigger", "phrase").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.first("sides").alias("sides")), "dictionary")

    # occurrences of a phrase but the first
    many = entries.where("n > 1").select("trigger", "phrase", "first")
    start = F.shiftright("at", 20)
    whole = scratch.table(rows.join(many, ["trigger", "phrase"]).where(place != F.col("first")).select("k", "th", start.alias("start"), (start + F.col("at").bitwiseAND(F.lit(1023)) + least).alias("end")), "whole")
    scratch.drop("phrases")

    # different phrases of one trigger that agree on one side
    left, right = F.shiftright("sides", 32), F.col("sides").bitwiseAND(F.lit(0xFFFFFFFF))
    sided = entries.select("first", F.explode(F.array(F.struct(F.xxhash64(F.lit(0), "trigger", left).alias("side"), F.lit(1).alias("which")), F.struct(F.xxhash64(F.lit(1), "trigger", right).alias("side"), F.lit(2).alias("which")))).alias("s")).select("first", "s.side", "s.which")
    shared = sided.groupBy("side").agg(F.count("*").alias("n")).where("n > 1").repartition("side", "n")
    edges = sided.join(shared, "side").select("first.*", F.struct("at", "which", "side", (F.col("n") > hot).alias("hot")).alias("edge"))
    lists = scratch.table(edges.groupBy("k", "th").agg(F.collect_list("edge").alias("edges")), "edges")
    texts = source.select("k", "th", "text").join(few(lists.select("k", "th").distinct()), ["k", "th"], "left_semi").join(lists, ["k", "th"]).dropDuplicates(["k", "th"])

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each edge, the bytes of its windows."""
        for batch in batches:
            for step in range(0, batch.num_rows, 200):
                some = batch.slice(step, 200)
                columns: list[list] = [[], [], [], [], [], []]
                for i, x in enumerate(some.column("text").to_pylist()):
                    found = some.column("edges")[i].values
                    at, which, side, is_hot = (found.field(f).to_numpy(zero_copy_only=False) for f in ("at", "which", "side", "hot"))
                    entry, a, b = _parts(at, which, least)
                    data = x.encode("utf-8", "surrogatepass")
                    k, th = some.column("k")[i].as_py(), some.column("th")[i].as_py()
                    for column, values in zip(columns, (side[entry].tolist(), [k] * len(entry), [th] * len(entry), a.tolist(), is_hot[entry].tolist(), [data[p : q + least] for p, q in zip(a.tolist(), b.tolist(), strict=True)]), strict=True):
                        column += values
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), k_arrow, pa.int32(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], ["side", "k", "th", "start", "hot", "data"])

    def window_hashes(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes of all rows, and of every window its first byte there, its hash and the number of its row)."""
        raw = np.frombuffer(b"".join(data), np.uint8)
        size = np.array([len(x) for x in data], np.int64)
        count = size - least + 1
        begin = np.repeat(np.cumsum(size) - size - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        return raw, begin, _hash(_sums(raw), begin, begin + least), np.repeat(np.arange(len(data)), count)

    def block(some: pa.Table) -> pa.RecordBatch:
        """Of the phrases of some sides, in the order of places: the windows that an earlier one has."""
        raw, begin, hashes, row = window_hashes(some.column("data").to_pylist())
        by = np.argsort(hashes, kind="stable")
        twin = np.zeros(len(by) + 1, bool)
        twin[1:-1] = hashes[by][1:] == hashes[by][:-1]
        likely = np.sort(by[twin[1:] | twin[:-1]])
        # rows of a side are in the order of places, but the sides' rows are one after the other
        places = pc.sort_indices(some.select(["k", "th", "start"]), sort_keys=[("k", "ascending"), ("th", "ascending"), ("start", "ascending")]).to_numpy()
        place = np.empty(some.num_rows, np.int64)
        place[places] = np.arange(some.num_rows)
        likely = likely[np.argsort(place[row[likely]], kind="stable")]
        order, same = suffix_order(raw, begin[likely], least)
        repeated = np.zeros(len(row), bool)
        repeated[likely[order[same]]] = True
        edge = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (repeated[1:] != repeated[:-1])]))
        end = np.append(edge[1:], len(row))
        edge, end = edge[repeated[edge]], end[repeated[edge]]
        firsts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=some.num_rows))[:-1]])
        r = row[edge]
        base, rows_of = some.column("start").to_numpy()[r] - firsts[r], pa.array(r)
        return pa.RecordBatch.from_arrays([some.column("k").combine_chunks().take(rows_of), some.column("th").combine_chunks().take(rows_of), pa.array(base + edge), pa.array(base + end - 1 + least)], ["k", "th", "start", "end"])

    def sorted_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in the order of side and place; the rows of a side are in one block."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for step in range(0, batch.num_rows, 4_000):
                some = batch.slice(step, 4_000)
                side = some.column("side").to_numpy()
                cut = int(np.flatnonzero(np.concatenate([[True], side[1:] != side[:-1]]))[-1])  # the last side may go on
                if cut or (held and held[-1].column("side")[-1].as_py() != side[0]):
                    yield block(pa.Table.from_batches([*held, some.slice(0, cut)]))
                    held = []
                held.append(some.slice(cut))
        if held:
            yield block(pa.Table.from_batches(held))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 4_000):
            raw, begin, hashes, row = window_hashes(batch.column("data").to_pylist())
            other = _hash(_sums(raw ^ np.uint8(0xA5)), begin, begin + least)
            firsts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))[:-1]])
            rows_of = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(other.view(np.int64)), batch.column("k").take(rows_of), batch.column("th").take(rows_of), pa.array(batch.column("start").to_numpy()[row] + np.arange(len(row)) - firsts[row])], ["window", "other", "k", "th", "s"])

    found = scratch.table(texts.mapInArrow(contexts, f"side long, k {k_type}, th int, start long, hot boolean, data binary"), "contexts")
    met = found.where(~F.col("hot")).drop("hot").repartition("side").sortWithinPartitions("side", "k", "th", "start")
    ranges = whole.union(scratch.table(met.mapInArrow(sorted_blocks, f"k {k_type}, th int, start long, end long"), "cold"))
    if found.where("hot").limit(1).count():
        cut = scratch.table(found.where("hot").mapInArrow(windows, f"window long, other long, k {k_type}, th int, s long"), "windows")
        at = F.struct("k", "th", "s")
        firsts = cut.groupBy("window", "other").agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1").select("window", "other", "first")
        single = cut.join(firsts, ["window", "other"]).where(at != F.col("first")).select("k", "th", F.col("s").alias("start"), (F.col("s") + least).alias("end"))
        ranges = ranges.union(scratch.table(single, "hot"))
    scratch.drop("contexts", "dictionary")
    return source, ranges


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that overlapping or touching ranges cover."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    return starts[at], reach[np.concatenate([at[1:] - 1, [len(starts) - 1]])]


def strip(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", least: int = 100) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept binary) for each row of ``docs``."""
    source, ranges = repeats(docs, scratch, key, text, least)
    kind = docs.schema[key].dataType.simpleString()
    by_text = scratch.table(ranges.groupBy("k", "th").agg(F.collect_set(F.struct("start", "end")).alias("ranges")), "by_text", stay=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                some = batch.slice(at, 200)
                kept, removed, spans = [], [], []
                for i, raw in enumerate(_bytes(some)):
                    found = some.column("ranges")[i].values
                    start, end = merged(found.field("start").to_numpy(), found.field("end").to_numpy())
                    edges = np.concatenate([[0], np.stack([start, end], 1).ravel(), [len(raw)]])
                    data = raw.tobytes()
                    kept.append(b"".join(data[i:j] for i, j in edges.reshape(-1, 2).tolist()))
                    removed.append(int((end - start).sum()))
                    spans.append(len(start))
                yield pa.RecordBatch.from_arrays([some.column("key"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], ["key", "n_removed", "n_spans", "kept"])

    names = few(by_text.select("k", "th"))
    touched = source.join(names, ["k", "th"], "left_semi").join(by_text, ["k", "th"])
    cut = touched.select("key", "text", "ranges").mapInArrow(run, f"key {kind}, n_removed long, n_spans long, kept binary")
    same = source.join(names, ["k", "th"], "left_anti").select("key", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("text").cast("binary").alias("kept"))
    scratch.drop()
    return cut.union(same).select(F.col("key").alias(key), (F.octet_length("kept") + F.col("n_removed")).alias("n_bytes"), "n_removed", "n_spans", "kept")

