"""N-gram Jaccard join by signature trees.

Documents are sets of distinct word shingles. Equal sets are one class. Two different sets with a
similarity of num / den or more differ in at most k shingles, and k follows from their sizes. So,
for each band of sizes, the hash space is cut into more than k parts: two linked sets have an equal
part. Each part's hash is a bucket key, and every linked pair meets in a bucket (a set with so many
empty parts that equal ones could all be empty is put in the buckets of its empty parts, too).
Within the buckets, signature trees find the links (``set_join``); the components of the links,
with a class as one node, are returned. Nothing is approximate but the 64-bit hashes.

Defined cases: null and empty texts, and texts of white space, have an empty set and are linked with
nothing; repeated rows and equal keys are rows of their own (rows with a null key take part in
components, and only a component without any other key has a null id); extra columns aren't
looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.common import Scratch, few, sliced
from corvane.llm.components import components
from corvane.llm.set_join import resolve
from corvane.llm.shingles import mix, set_id, shingle_set

#: Sets whose buckets a task has given already and needn't give again.
REMEMBERED = 1 << 20
#: Texts that are hashed before their rows leave a worker.
AT_ONCE = 500


@lru_cache(maxsize=64)
def bands(num: int, den: int) -> tuple[list[int], list[int], list[int], list[int]]:
    """By band of the lesser size: the first size, the largest partner, k, and the number of parts.

    At sizes a <= b, an overlap of at least num * (a + b) / (num + den) leaves at most
    a + b - 2 * overlap different shingles.
    """
    firsts, partners, most, parts = [], [], [], []
    first = 1
    while first < 1 << 40:
        after = max(first + 1, first * 3 // 2)
        partner = (after - 1) * den // num
        total = after - 1 + partner
        k = max(s - 2 * -(-num * s // (num + den)) for s in range(max(2 * first, total - 2 * (num + den)), total + 1))
        firsts.append(first)
        partners.append(partner)
        most.append(k)
        parts.append(k + 2 + k // 16)
        first = after
    return firsts, partners, most, parts


def bucket_keys(hashes: np.ndarray, num: int, den: int) -> np.ndarray:
    """The keys (uint64) of the buckets that a set is in."""
    firsts, partners, most, parts = bands(num, den)
    n, out = len(hashes), []
    own = int(np.searchsorted(firsts, n, "right")) - 1
    for band in (own - 1, own):
        if band < 0 or n > partners[band] or most[band] == 0:
            continue
        p = parts[band]
        part = ((hashes >> np.uint64(32)) * np.uint64(p)) >> np.uint64(32)  # ascending, as the hashes are
        at = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1])
        name = np.uint64(band << 40) + part[at]
        out.append(mix(np.add.reduceat(mix(hashes), at) ^ mix(name + np.uint64(1))))
        if p - len(at) >= p - most[band]:
            empty = np.setdiff1d(np.arange(p, dtype=np.uint64), part[at])
            out.append(mix(np.uint64(band << 40) + empty + np.uint64(1 << 62)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def classes(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(key, n, sid) for each row: the number of shingles and the name of their set."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = [shingle_set(x or "", size) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([len(x) for x in sets], pa.int64()), pa.array([set_id(x) for x in sets], pa.int64())], ["key", "n", "sid"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n long, sid long")


def thinned(keys: np.ndarray, sids: np.ndarray) -> pa.RecordBatch:
    """(key, salt, sid). Sets beyond the second of a bucket in these rows need no partner from elsewhere
    to prove that the bucket is shared: they get a salt, and don't meet in one task."""
    order = np.lexsort((sids, keys))
    keys, sids = keys[order], sids[order]
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (sids[1:] != sids[:-1])]) if len(keys) else np.zeros(0, bool)
    keys, sids = keys[new], sids[new]  # a repeat of the first set isn't a second one
    firsts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    place = np.arange(len(keys)) - np.repeat(firsts, np.diff(np.append(firsts, len(keys))))
    salt = np.where(place > 1, 1 + (sids & 63), 0).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(salt), pa.array(sids)], ["key", "salt", "sid"])


def shared_buckets(buckets: DataFrame) -> DataFrame:
    """(key, sid) of the buckets (key, salt, sid) that two sets or more are in."""
    of = Window.partitionBy("key", "salt")
    return buckets.withColumn("low", F.min("sid").over(of)).withColumn("high", F.max("sid").over(of)).where("salt > 0 or low <> high").select("key", "sid").distinct()


def holders(docs: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key is one of ``first`` of ``wanted``, null included."""
    names = few(wanted.select("first").distinct())
    return docs.join(names, docs[key].eqNullSafe(names["first"]), "left_semi")


def _buckets(docs: DataFrame, text: str, size: int, num: int, den: int) -> DataFrame:
    """(key, salt, sid): the buckets of every set, without most repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                keys, sids, counts = [], [], []
                for x in batch.column("text").slice(at, AT_ONCE).to_pylist():
                    hashes = shingle_set(x or "", size)
                    sid = set_id(hashes)
                    if sid in known or not sid:
                        continue
                    known = known if len(known) < REMEMBERED else set()
                    known.add(sid)
                    keys.append(bucket_keys(hashes, num, den))
                    sids.append(sid)
                    counts.append(len(keys[-1]))
                if sum(counts):
                    yield thinned(np.concatenate(keys).view(np.int64), np.repeat(np.array(sids, np.int64), counts))

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "key long, salt int, sid long")


def _sets(docs: DataFrame, text: str, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                sets = [shingle_set(x or "", size) for x in batch.column("text").slice(at, AT_ONCE).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([set_id(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.astype("<u8").tobytes() for x in sets], pa.binary())], ["sid", "n", "hashes"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "sid long, n long, hashes binary")


def join(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", size: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """(key, n_shingles, component_id) for each row of ``docs``: its component's least key.

    Documents link where den * |A & B| >= num * |A | B|.
    """
    rows = scratch.table(classes(docs, key, text, size), "classes")
    named = rows.where("sid <> 0").groupBy("sid").agg(F.min("key").alias("first"))
    members = scratch.table(shared_buckets(_buckets(docs, text, size, num, den)), "members")
    wanted = scratch.table(members.select("sid").distinct().join(named, "sid").select("sid", "first"), "wanted")
    some = holders(docs.select(key, text), key, wanted)
    sets = scratch.table(_sets(some, text, size).join(few(wanted.select("sid")), "sid", "left_semi").dropDuplicates(["sid"]), "sets")
    links = resolve(members, sets, scratch, num, den)
    found = components(links, scratch, "links").select(F.col("id").alias("sid"), "component")
    groups = named.join(found, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    least = groups.groupBy("component").agg(F.min("first").alias("component_id"))
    by_set = scratch.table(groups.join(least, "component").select("sid", "component_id"), "component_of_set")
    out = rows.join(by_set, "sid", "left").select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("sid") == 0, F.col("key")).otherwise(F.col("component_id")).alias("component_id"))
    result = scratch.table(out, "result", stay=True)
    scratch.drop()
    return result


def one_of_each(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` whose key is their component's least; repeated rows of such a key stay together."""
    found = join(docs, scratch, key, text, size, num, den)
    return docs.join(few(found.where(F.col(key) != F.col("component_id")).select(key).distinct()), key, "left_anti").select(docs.columns)
