"""Components of similar sets, from buckets that hold every pair which may be similar.

Given members (key, sid) of buckets and each set's hashes, two sets are linked if they share a
bucket and ``den * |A & B| >= num * |A | B|``. ``resolve`` returns links whose components are those of
all links. It never lists the pairs of a bucket:

1. Stars. A few times, each set is compared, exactly, with one set of its buckets: the one that
   comes first in a hash order drawn anew. Most of a group of near copies is connected by these.
2. Signature trees. Only buckets that still hold several components are left, and of buckets with
   the same members one. Each makes a tree of its sets' bitmaps; the dual traversal drops pairs that
   can't be similar or are connected. A bucket with more than ``cell_members`` sets is dealt to
   cells, one for each two of its blocks, so that no task gets an unbounded bucket.
3. The pairs that survive make families (components), in which each set stands once. A family's sets
   are compared exactly, again by a tree, skipping pairs that links found on the way have connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import Scratch, few, sliced
from corvane.llm.components import components
from corvane.llm.signature_tree import Forest, Tree, bitmap, folded, width




def similar(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Exactly: whether two ascending arrays without repeats reach the Jaccard similarity num / den."""
    if min(len(x), len(y)) * den < max(len(x), len(y)) * num:
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared * den >= num * (len(x) + len(y) - shared)


def _arrays(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u8") for x in column.to_pylist()]



def _star(members: DataFrame, sets: DataFrame, scratch: Scratch, seed: int, num: int, den: int) -> DataFrame:
    """Links (a, b) between sets and one centre each."""
    order = F.struct(F.xxhash64(F.lit(seed), "sid"), F.col("sid"), F.col("label"))
    centres = members.groupBy("key").agg(F.min(order).alias("centre"))
    chosen = members.join(centres, "key").where(F.col("label") != F.col("centre.label")).groupBy("sid").agg(F.min("centre").alias("centre"))
    pairs = scratch.table(chosen.select("sid", F.col("centre.sid").alias("centre")), f"pairs_{seed}")
    # only the sets that take part are shuffled: those of the centres, and beside them each set once
    centre_sets = sets.join(few(pairs.select(F.col("centre").alias("sid")).distinct()), "sid", "left_semi")
    left = sets.select(F.col("sid"), F.col("hashes").alias("x")).join(few(pairs), "sid")
    right = centre_sets.select(F.col("sid").alias("centre"), F.col("hashes").alias("y"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            good = [similar(x, y, num, den) for x, y in zip(_arrays(batch.column("x")), _arrays(batch.column("y")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("sid"), batch.column("centre")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return left.join(right, "centre").select("sid", "centre", "x", "y").mapInArrow(verify, "a long, b long")


def _labelled(members: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Members of the buckets that hold several components, with each one's component as label."""
    found = components(links, scratch, name)
    out = members.select("key", "sid").join(found.select(F.col("id").alias("sid"), F.col("component").alias("label")), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    open_keys = out.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    return out.join(open_keys, "key")


def _once(members: DataFrame) -> DataFrame:
    """Of buckets with the same members, one, with its size."""
    of = members.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("sid")).alias("x"), F.sum(F.shiftright(F.xxhash64(F.lit(7), "sid"), 24)).alias("y"))
    return members.join(of.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", "n"), "key")


def _cells(members: DataFrame, blocks: Column) -> DataFrame:
    """(key, i, j, ...): a row for each cell of its bucket of so many blocks that a member has to be in."""
    own = F.pmod(F.xxhash64("sid"), F.col("blocks"))
    cells = members.withColumn("blocks", blocks.cast("int")).withColumn("own", own.cast("int"))
    return cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("own", "other", "blocks")


def _tree(labels: np.ndarray, sizes: np.ndarray, maps: list[np.ndarray]) -> tuple[np.ndarray, Tree]:
    """The order in which sets that are connected or of like size stand together, and their tree."""
    order = np.lexsort((sizes, labels))
    bits = min(len(x) for x in maps) * 64
    return order, Tree(np.stack([folded(maps[i], bits) for i in order]), sizes[order], labels[order])


def resolve(members: DataFrame, sets: DataFrame, scratch: Scratch, num: int, den: int, stars: int = 4, worth: float = 0.95, cell_members: int = 20_000, exact_members: int = 400, exact_bytes: int = 16 << 20, turns: int = 4) -> DataFrame:
    """Links (a, b). members: (key long, sid long); sets: (sid long, n long, hashes binary: ascending
    little-endian 64-bit values), both written tables."""
    links = None
    open_members, before = members.select("key", "sid", F.col("sid").alias("label")), None
    for i in range(stars):
        found = scratch.table(_star(open_members, sets, scratch, i, num, den), f"star_{i}")
        links = found if links is None else links.union(found)
        open_members = scratch.table(_labelled(open_members, links, scratch, f"after_star_{i}"), f"open_{i}")
        scratch.drop(f"pairs_{i}", *([f"open_{i - 1}"] if i else []))
        left = open_members.select("label").distinct().count()
        if before is not None and left > worth * before:  # what is open now is mostly unlike; another star would connect little
            break
        before = left

    def to_bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            maps = [bitmap(x, width(len(x))).tobytes() for x in _arrays(batch.column("hashes"))]
            yield pa.RecordBatch.from_arrays([batch.column("sid"), batch.column("n"), pa.array(maps, pa.binary())], ["sid", "n", "map"])

    def survivors(cell: pa.Table) -> pa.Table:
        """The members that may be similar to one of another component, grouped by such pairs."""
        sids, sizes = cell.column("sid").to_numpy(), cell.column("size").to_numpy()
        _, labels = np.unique(cell.column("label").to_numpy(), return_inverse=True)
        order, tree = _tree(labels, sizes, _arrays(cell.column("map")))
        forest, hit = Forest(len(sids)), np.zeros(len(sids), bool)
        for i, j, _ in tree.pairs(num, den):
            hit[i] = hit[j] = True
            edges = np.unique(np.stack([i, j], 1), axis=0)
            for a, b in edges.tolist():
                forest.join(a, b)
        kept = np.flatnonzero(hit)
        group = np.array([forest.root(int(x)) for x in kept], np.int64)
        names = sids[order]
        firsts = names[group] if len(kept) else group
        n = len(kept)
        return pa.table({"key": pa.array(np.full(n, cell.column("key")[0].as_py(), np.int64)), "i": pa.array(np.full(n, cell.column("i")[0].as_py(), np.int32)), "j": pa.array(np.full(n, cell.column("j")[0].as_py(), np.int32)), "part": pa.array(firsts), "sid": pa.array(names[kept] if n else kept), "label": pa.array(cell.column("label").to_numpy()[order][kept] if n else kept)})

    def compare(cell: pa.Table) -> pa.Table:
        sids, values = cell.column("sid").to_numpy(), _arrays(cell.column("hashes"))
        sizes = np.array([len(x) for x in values], np.int64)
        _, labels = np.unique(cell.column("label").to_numpy(), return_inverse=True)
        bits = 4 * width(int(sizes.max()))
        order, tree = _tree(labels, sizes, [bitmap(x, bits) for x in values])
        forest, links = Forest(int(labels.max()) + 1), []
        for i, j, most in tree.pairs(num, den):
            first = np.argsort(-most, kind="stable")
            for a, b in zip(order[i[first]].tolist(), order[j[first]].tolist(), strict=True):
                if forest.root(int(labels[a])) != forest.root(int(labels[b])) and similar(values[a], values[b], num, den):
                    forest.join(int(labels[a]), int(labels[b]))
                    links.append((sids[a], sids[b]))
        ends = np.array(links, np.int64).reshape(-1, 2)
        return pa.table({"a": ends[:, 0], "b": ends[:, 1]})

    maps = scratch.table(sets.join(few(open_members.select("sid").distinct()), "sid", "left_semi").select("sid", "n", "hashes").mapInArrow(to_bitmap, "sid long, size long, map binary"), "bitmaps")
    once, left = scratch.table(_once(open_members), "once"), None
    for turn in range(turns):  # a bitmap goes to every bucket of its set: a share of the buckets at a time
        cells = _cells(once.where(F.pmod(F.xxhash64("key"), F.lit(turns)) == turn), F.ceil(F.col("n") / cell_members)).drop("n").join(maps, "sid")
        found = scratch.table(cells.groupBy("key", "i", "j").applyInArrow(survivors, "key long, i int, j int, part long, sid long, label long"), f"survivors_{turn}")
        left = found if left is None else left.union(found)
    scratch.drop("bitmaps", "once")
    # sets that may be similar, directly or over others, are one family; each is in one, and goes there once
    families = components(left.select(F.col("part").alias("a"), F.col("sid").alias("b")), scratch, "families")
    named = left.select("sid", "label").distinct().join(families.select(F.col("id").alias("sid"), F.col("component").alias("key")), "sid")
    names = scratch.table(named, "family_names")
    some = sets.select("sid", "n", "hashes").join(few(names.select("sid")), "sid", "left_semi")
    sized = names.join(some.select("sid", "n"), "sid")
    of = sized.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / exact_members), F.ceil(F.sum("n") * 8 / exact_bytes)).alias("parts"))
    cells = _cells(names.join(of, "key"), F.col("parts")).drop("parts").join(some.drop("n"), "sid")
    last = cells.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")
    return links.union(scratch.table(last, "exact"))
